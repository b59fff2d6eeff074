"""Problem 8: evaluation passages inside training texts, by Wu-Manber search for many patterns.

Patterns are all windows of ten words of every passage, as one run of letters and digits. A text is
reduced to the same alphabet, with a flag wherever a word begins. The search looks at the last block of a
window: the shift table tells how far no pattern can end, the bucket of the block lists the patterns
that may end here, and a direct comparison confirms them, with word limits at both ends.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import written

WORDS = 10
BLOCK = 5
#: Bytes of windows that go to the executors together, at most. More windows take more rounds over the texts.
ROUND_BYTES = 32 << 20

_TAG = re.compile(r"<[/!]?[a-zA-Z][^<>]*+>")
_SHORT_TAG = re.compile(r"<[/!]?[a-zA-Z][^<>]{0,200}>")
_SHORT_COMMENT = re.compile(r"<!--.{0,500}?-->", re.S)
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")
_ASCII = re.compile(r"[a-z0-9]+")


def _without_comments(text: str) -> str:
    out, at = [], 0
    while (lo := text.find("<!--", at)) >= 0 and (hi := text.find("-->", lo + 4)) >= 0:
        out.append(text[at:lo])
        at = hi + 3
    return " ".join([*out, text[at:]])


def readings(text: str) -> list[list[str]]:
    """Words of a text in lower case without accents, punctuation, markup and invisible characters, in each way to read it.

    Markup of any length is set aside. As what looks like a long tag or comment may be text between two signs, such a text
    is also read with its long tags, its long comments or both left in.
    """
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" not in text:
        return [_words(text)]
    bare = [_without_comments(text), _SHORT_COMMENT.sub(" ", text)]
    return [_words(t) for t in dict.fromkeys(tag.sub(" ", t) for t in bare for tag in (_TAG, _SHORT_TAG))]


def plain_words(text: str) -> list[str]:
    """The reading without any markup."""
    return readings(text)[0]


def _words(text: str) -> list[str]:
    if text.isascii():
        return _ASCII.findall(text.lower())
    text = _INVISIBLE.sub("", text)
    text = unicodedata.normalize("NFKD", text).casefold()
    text = "".join(c for c in text if not unicodedata.combining(c))
    return _WORD.findall(text)


class WuManber:
    """Shift and suffix tables over patterns of unequal length (all at least ``BLOCK`` long)."""

    def __init__(self, patterns: dict[str, list]):
        self.least = m = min(map(len, patterns), default=0)
        self.block = b = min(BLOCK, m) if m else 1
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, list[tuple[str, list]]] = {}
        for p, owners in patterns.items():
            # only the first m characters steer the shifts; the rest is compared directly
            for end in range(b, m + 1):
                key, jump = p[end - b : end], m - end
                if jump < self.shift.get(key, m):
                    self.shift[key] = jump
            self.bucket.setdefault(p[m - b : m], []).append((p, owners))
        self.far = m - b + 1

    def search(self, text: str) -> Iterator[tuple[int, str, list]]:
        """(start, pattern, owners) of every occurrence."""
        m, b, far, shift, bucket = self.least, self.block, self.far, self.shift, self.bucket
        if not m:
            return
        end, n = m, len(text)
        while end <= n:
            key = text[end - b : end]
            jump = shift.get(key, far)
            if jump:
                end += jump
                continue
            start = end - m
            for p, owners in bucket[key]:
                if text.startswith(p, start):
                    yield start, p, owners
            end += 1


def passage_windows(passages: list[tuple[int, str | None]], words: int = WORDS) -> dict[str, list]:
    """Every run of ``words`` words of the passages, joined, with the ids it belongs to."""
    out: dict[str, list] = {}
    for key, passage in passages:
        for w in readings(passage or ""):
            for k in range(len(w) - words + 1):
                owners = out.setdefault("".join(w[k : k + words]), [])
                if key not in owners:
                    owners.append(key)
    return out


def leaked_items(text: str | None, tables: WuManber) -> set:
    return set().union(*(_leaked(words, tables) for words in readings(text))) if text else set()


def _leaked(words: list[str], tables: WuManber) -> set:
    joined = "".join(words)
    if len(joined) < tables.least:
        return set()
    found: set = set()
    limits: set[int] | None = None
    for start, pattern, owners in tables.search(joined):
        if limits is None:
            limits, at = {0}, 0
            for w in words:
                at += len(w)
                limits.add(at)
        if start in limits and start + len(pattern) in limits:
            found.update(owners)
    return found


def passage_leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "eval_id", passage: str = "passage", words: int = WORDS
) -> DataFrame:
    """(``doc_id``, ``eval_id``), once each, where a text holds ``words`` consecutive words of a passage.

    Null and empty texts and passages leak nothing; passages shorter than ``words`` words have no window.
    The windows of all passages are made and counted in tasks; they go to the executors in rounds of about ``ROUND_BYTES``
    bytes, so what is sent is bounded however many or long the passages are. Each text is read whole.
    """
    spark = documents.sparkSession
    held = items.select(F.col(item_id).cast("long").alias("_item"), F.col(passage).alias("_passage")).where("_item is not null and _passage is not null")
    docs = documents.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).where("_text is not null and _text <> ''")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, i) for i, t in zip(f["_item"], f["_passage"]) for p in passage_windows([(i, t)], words)]
            yield pd.DataFrame(rows, columns=["pattern", "item"])

    windows = written(held.mapInPandas(cut, "pattern string, item long").distinct(), "windows")
    total = windows.agg(F.coalesce(F.sum(F.octet_length("pattern") + 8), F.lit(0)).alias("n")).first()["n"]
    rounds = max(1, -(-total // ROUND_BYTES))
    doc_type = documents.schema[doc_id].dataType.simpleString()
    out = None
    for r in range(rounds):
        table: dict[str, list] = {}
        for pattern, item in windows.where(F.pmod(F.xxhash64("pattern"), F.lit(rounds)) == r).toLocalIterator():
            table.setdefault(pattern, []).append(item)
        sent = spark.sparkContext.broadcast(table)

        def scan(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            tables = WuManber(sent.value)
            for f in frames:
                rows = [(d, e) for d, t in zip(f["_doc"], f["_text"]) for e in sorted(leaked_items(t, tables))]
                yield pd.DataFrame(rows, columns=["doc_id", "eval_id"])

        part = docs.mapInPandas(scan, f"doc_id {doc_type}, eval_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
