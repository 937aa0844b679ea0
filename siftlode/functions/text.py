"""Text scalars: normalisation, filter strings, document texts, n-grams. All are column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control characters that mark a key and its end while a filter string is taken apart.
_KEY, _END = "\x01", "\x02"


#: What separates words of lowered texts.
BETWEEN = "[^0-9a-zа-я]+"


def lowered(text: Column) -> Column:
    """Lower case, one letter for its dotted form; null becomes empty."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ё"), F.lit("е"))


def normalize(text: Column) -> Column:
    """Lower case, one letter for its dotted form, and single spaces for whatever is not a digit or a Latin or Cyrillic
    letter; null becomes empty. Accented Latin letters separate words."""
    return F.trim(F.regexp_replace(lowered(text), BETWEEN, " "))


def has_filter(params: Column) -> Column:
    return F.trim(F.coalesce(params, F.lit(""))) != ""


def filter_key_pattern(keys: Sequence[str]) -> str:
    """Regular expression of the keys as whole phrases between spaces, longer keys first."""
    return "(?:^|(?<= ))(" + "|".join(re.escape(k).replace("\\ ", " ") for k in sorted(keys, key=len, reverse=True)) + ")(?= |$)"


def parse_filters(params: Column, keys: Sequence[str]) -> Column:
    """Array of (key, value) in order: a value reaches to the next key or the end and may be empty; what stands before the
    first key is dropped; a key may repeat."""
    marked = F.regexp_replace(F.coalesce(params, F.lit("")), filter_key_pattern(keys), f"{_KEY}$1{_END}")
    parts = F.split(marked, _KEY)
    pair = lambda x: F.struct(F.split(x, _END)[0].alias("key"), F.trim(F.split(x, _END)[1]).alias("value"))
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), pair)


def remove_noise(text: Column, patterns: Sequence[str]) -> Column:
    """Each pattern's matches, one pattern after the other, become a space."""
    for p in patterns:
        text = F.regexp_replace(text, p, " ")
    return text


def _cut(text: Column, max_chars: int | None) -> Column:
    return F.substring(text, 1, max_chars) if max_chars else text


def doc_text(fields: Sequence[dict], noise: Sequence[str] = (), noisy: str = "item_infm_params_text") -> Column:
    """Normalised text of an item: of each field {col, max_chars?, repeat?}, noise (in the parameters only) is removed,
    then it is cut, then repeated."""
    parts: list[Column] = []
    for f in fields:
        c = F.coalesce(F.col(f["col"]).cast("string"), F.lit(""))
        if noise and f["col"] == noisy:
            c = remove_noise(c, noise)
        parts += [_cut(c, f.get("max_chars"))] * f.get("repeat", 1)
    return normalize(F.concat_ws(" ", *parts))


def raw_doc_text(fields: Sequence[dict]) -> Column:
    """Text of an item as an encoder wants it: cut fields joined by ". ", without spaces and dots at the ends."""
    parts = [_cut(F.coalesce(F.col(f["col"]).cast("string"), F.lit("")), f.get("max_chars")) for f in fields]
    return F.btrim(F.concat_ws(". ", *parts), F.lit(" ."))


def words(text: Column) -> Column:
    """Words between spaces."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")


def _window(text: Column, n: int):
    return lambda i: F.substr(text, i, F.lit(n))


def _joined(parts: Column, n: int):
    return lambda i: F.array_join(F.slice(parts, i, n), " ")


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """Character n-grams inside words padded by a space; a padded word no longer than n gives itself once, at the first
    such n, and nothing at longer ones."""

    def of_word(p: Column) -> Column:
        sized = []
        for n in range(low, high + 1):
            grams = F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), _window(p, n))
            # a word shorter than n was given whole at the first n
            short = F.array(p) if n == low else F.array().cast("array<string>")
            sized.append(F.when(F.length(p) >= n, grams).otherwise(short))
        return F.flatten(F.array(*sized))

    padded = F.transform(words(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, of_word))


def word_ngrams(text: Column, low: int = 1, high: int = 2) -> Column:
    """Runs of ``low`` to ``high`` words, joined by a space."""

    def of_text(w: Column) -> Column:
        out = []
        for n in range(low, high + 1):
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
            out.append(F.transform(starts, _joined(w, n)))
        return F.flatten(F.array(*out))

    # the words are bound once, not worked out anew for each run
    return F.flatten(F.transform(F.array(words(text)), of_text))


def lemmatize(rows: DataFrame, text: str, lemmas: DataFrame, out: str, row_id: str) -> DataFrame:
    """``rows`` with ``out``: the words of ``text`` replaced by their lemmas (word, lemma), others unchanged.

    Only distinct words meet the dictionary; texts are put together again in order.
    """
    # the dictionary has one row a word
    dictionary = lemmas.groupBy("word").agg(F.min("lemma").alias("lemma"))
    each = rows.select(row_id, F.posexplode(words(F.col(text))).alias("__at", "word"))
    named = each.join(dictionary, "word", "left").select(row_id, "__at", F.coalesce("lemma", "word").alias("__w"))
    whole = named.groupBy(row_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__w"))), lambda x: x["__w"]), " ").alias(out))
    return rows.join(whole, row_id, "left").withColumn(out, F.coalesce(out, F.lit("")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), h))))


def cell_name(slice_: Column, filtered: Column) -> Column:
    return F.concat(slice_, F.when(filtered, F.lit("_filter")).otherwise(F.lit("_nofilter")))
