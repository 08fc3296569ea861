"""Scalar text functions as columns: tokens, sizes, ids, hashes, snippets, truncation.

All stay in the JVM. Those built on lambdas (``fnv1a``, ``features``) are meant for distinct tokens, not
for every occurrence; ``operators.postings`` uses them that way.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that make one estimated token.
CHARS_PER_TOKEN = 4
#: Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
#: Buckets of the hashing embedder.
DIMENSIONS = 2048
SNIPPET_CHARS, SNIPPET_LEAD = 240, 40


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text: Column | str) -> Column:
    """Lower-case ASCII letter and digit runs, in order; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(_col(text), F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def estimate_tokens(text: Column | str) -> Column:
    """Code points over four, rounded up; null counts as empty."""
    return F.ceil(F.length(F.coalesce(_col(text), F.lit(""))) / CHARS_PER_TOKEN).cast("long")


def stable_id(seed: Column | str, prefix: str) -> Column:
    """prefix and the first 16 hex digits of the seed's SHA-256."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(_col(seed), 256), 1, 16))


def memory_seed(kind: Column | str, key: Column | str, content: Column | str, origin: Column | str, author: Column | str) -> Column:
    """The text that a memory's id is derived from; the timestamp isn't part of it."""
    return F.concat_ws(" ", _col(kind), F.coalesce(_col(key), F.lit("")), _col(content), _col(origin), _col(author))


def fnv1a(text: Column | str) -> Column:
    """32-bit FNV-1a over the UTF-8 bytes, as a BIGINT."""
    octets = F.filter(F.split(F.hex(_col(text).cast("binary")), "(?<=\\G..)"), lambda h: h != "")
    step = lambda acc, h: ((acc.bitwiseXOR(F.conv(h, 16, 10).cast("long"))) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.aggregate(octets, F.lit(FNV_OFFSET).cast("long"), step)


def features(token: Column | str) -> Column:
    """A token's features: itself, and the trigrams of '#token#'."""
    t = _col(token)
    padded = F.concat(F.lit("#"), t, F.lit("#"))
    grams = F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.lit("t:"), F.substring(padded, i, F.lit(3))))
    return F.concat(F.array(F.concat(F.lit("w:"), t)), grams)


def trigram_hash(padded: Column, place: Column) -> Column:
    """``fnv1a`` of 't:' and three ASCII characters of a text, unrolled: no lambda, so it is compiled."""
    h = F.lit(_fold(b"t:")).cast("long")
    for k in range(3):
        octet = F.ascii(F.substring(padded, place + k, F.lit(1))).cast("long")
        h = (h.bitwiseXOR(octet) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return h


def _fold(octets: bytes) -> int:
    h = FNV_OFFSET
    for b in octets:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFF
    return h


def bucket(feature: Column | str) -> Column:
    """The embedding bucket of a feature."""
    return (fnv1a(feature) % DIMENSIONS).cast("int")


def token_list(query: str) -> list[str]:
    """Tokens of one text in order, on the driver; the meaning of ``tokenize``."""
    return re.findall("[a-z0-9]+", query.lower())


def query_tokens(query: str) -> Counter[str]:
    """Token counts of one query text, on the driver."""
    return Counter(token_list(query))


def query_buckets(tokens: Counter[str]) -> Counter[int]:
    """Bucket counts of a query's tokens, on the driver; the meaning of ``features`` and ``bucket``."""
    out: Counter[int] = Counter()
    for token, n in tokens.items():
        padded = f"#{token}#"
        for f in [f"w:{token}", *[f"t:{padded[i : i + 3]}" for i in range(len(token))]]:
            out[_fold(f.encode()) % DIMENSIONS] += n
    return out


def collapse(text: Column | str) -> Column:
    """Runs of white space made one space, ends trimmed."""
    return F.btrim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?U)\s+", " "), F.lit(" "))


def snippet(query: Column | str, text: Column | str) -> Column:
    """240 characters of the collapsed text from 40 before the first hit of any query token."""
    flat, terms = collapse(text), tokenize(query)
    hits = F.filter(F.transform(terms, lambda t: F.instr(F.lower(flat), t)), lambda p: p > 0)
    first = F.coalesce(F.array_min(hits), F.lit(1)) - 1
    return F.substring(flat, F.greatest(first - SNIPPET_LEAD, F.lit(0)) + 1, F.lit(SNIPPET_CHARS))


def truncate_words(text: Column | str, max_tokens: int) -> Column:
    """The text cut to max_tokens * 4 characters, back to the last space if there is one beyond the start."""
    t, most = _col(text), max_tokens * CHARS_PER_TOKEN
    cut = F.substring(t, 1, most)
    back = F.instr(F.reverse(cut), " ")
    keep = F.length(cut) - back
    shortened = F.when((back > 0) & (keep > 0), F.substring(cut, F.lit(1), keep)).otherwise(cut)
    return F.when(F.length(t) > most, F.regexp_replace(shortened, r"(?U)\s+$", "")).otherwise(t)


def clip(text: Column | str, max_tokens: int = 500) -> Column:
    """struct(content, truncated): the first max_tokens * 4 characters; null stays null."""
    t, most = _col(text), max_tokens * CHARS_PER_TOKEN
    made = F.struct(F.substring(t, 1, most).alias("content"), (F.length(t) > most).alias("truncated"))
    return F.when(t.isNotNull(), made)


def mentions(source_tokens: Column, title: Column | str, basename: Column | str) -> Column:
    """Whether the tokens of title or basename stand in a row among the source's tokens.

    A needle of fewer than three characters in all never counts.
    """
    hay = F.concat(F.lit(" "), F.array_join(source_tokens, " "), F.lit(" "))

    def one(needle: Column) -> Column:
        tokens = tokenize(needle)
        return (F.length(F.array_join(tokens, "")) >= 3) & F.contains(hay, F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")))

    return one(_col(title)) | one(_col(basename))


def basename(note_id: Column | str) -> Column:
    """The part of an id after its last slash."""
    return F.substring_index(_col(note_id), "/", -1)
