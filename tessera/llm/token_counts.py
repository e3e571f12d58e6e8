"""Operator 5: token counts by a two-tier lookup of pre-tokens, without a shuffle.

A byte-level BPE encodes each pre-token by itself, so a text's count is the sum of its
pre-tokens' lengths. The first tier is a table of the most frequent pre-tokens and their
lengths, broadcast once as one string and one array of bytes. What it lacks is encoded by
the tokenizer library and remembered in the worker's second tier, which is emptied when
full. Both tiers only save work: every length is the library's own, so the counts don't
depend on which pre-tokens are in them, and the first tier may come from a bounded sample.

Texts that hold the string of an added token are counted by the library as a whole, and so are all
texts if the file cuts or changes them in another way than byte-level BPE of this family does.
"""

from __future__ import annotations

import collections
import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, whole_text

#: Documents that the first tier is drawn from, at most about.
SAMPLE_DOCS = 2_000
#: Pre-tokens of the first tier, and of a worker's second tier, at most.
FIRST_TIER, SECOND_TIER = 65_536, 400_000
#: The longest pre-token that is kept in a tier.
LONGEST_KEPT = 64
#: How byte-level BPE of this family cuts a text into pre-tokens (a fixed value).
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts_by_pattern(tokenizer: str) -> bool:
    """Whether a tokenizer file cuts texts by PRE_TOKENS, and encodes pre-tokens each by itself."""
    file = json.loads(tokenizer)
    model, cut = file.get("model") or {}, file.get("pre_tokenizer") or {}
    by_bytes = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True)
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    return by_bytes and plain and file.get("normalizer") is None


class PreTokenCounter:
    """Lengths of pre-tokens in two tiers. Made anew from its packed form in each worker."""

    def __init__(self, tokenizer: str, words: list[str], lengths: list[int]):
        fits = [(w, n) for w, n in zip(words, lengths, strict=True) if n < 256 and "\x00" not in w]
        self.tokenizer = tokenizer
        self.words = "\x00".join(w for w, _ in fits)
        self.lengths = np.array([n for _, n in fits], np.uint8).tobytes()
        self._open = None

    def __getstate__(self):
        return {"tokenizer": self.tokenizer, "words": self.words, "lengths": self.lengths, "_open": None}

    def _start(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(self.tokenizer)
        library.no_truncation()
        library.no_padding()
        added = [t["content"] for t in json.loads(self.tokenizer).get("added_tokens") or []]

        class Tiers(dict):
            """First tier, and misses remembered up to a bound."""

            room = SECOND_TIER

            def __missing__(self, word):
                n = len(library.encode(word, add_special_tokens=False).ids)
                if len(word) <= LONGEST_KEPT:
                    if self.room == 0:
                        self.clear()
                        self.update(first)
                        self.room = SECOND_TIER
                    self[word] = n
                    self.room -= 1
                return n

        first = dict(zip(self.words.split("\x00"), self.lengths, strict=True)) if self.lengths else {}
        self._open = library, added, regex.compile(PRE_TOKENS) if cuts_by_pattern(self.tokenizer) else None, Tiers(first)

    def pre_tokens(self, text: str) -> list[str]:
        if self._open is None:
            self._start()
        return self._open[2].findall(text) if self._open[2] else []

    def length(self, word: str) -> int:
        return self._open[3][word]

    def count(self, text: str) -> int:
        if self._open is None:
            self._start()
        library, added, pattern, tiers = self._open
        if pattern is None or any(a in text for a in added):
            return len(library.encode(text, add_special_tokens=False).ids)
        return sum(map(tiers.__getitem__, pattern.findall(text)))


def frequent_pre_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> PreTokenCounter:
    """The first tier, of a sample of at most about ``sample_docs`` documents, counted in one task."""
    n = docs.count()
    counter = PreTokenCounter(tokenizer, [], [])
    if not n or not cuts_by_pattern(tokenizer):
        return counter

    def most(batches):
        seen = collections.Counter()
        for pdf in batches:
            for text in pdf["text"]:
                seen.update(w for w in counter.pre_tokens(text) if len(w) <= LONGEST_KEPT)
        top = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:FIRST_TIER]]
        yield pd.DataFrame({"word": top, "n": [counter.length(w) for w in top]})

    sample = docs.select(whole_text(text_col).alias("text")).sample(min(1.0, sample_docs / n), seed=5)
    top = sample.repartition(1).mapInPandas(most, "word string, n int").toPandas()
    return PreTokenCounter(tokenizer, list(top["word"]), list(top["n"]))


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``tokenizer_file`` is a file of the tokenizers library, read by the driver, that travels with
    the table; the tiers serve those with byte-level pre-tokens, others are counted by the library. No begin, end or special tokens are
    added, nothing is cut or padded. Null and empty texts have 0 bytes and 0 tokens; an
    empty table gives no rows; repeated rows are counted each. Very long texts are counted
    whole, in memory of some dozen times their own. Other columns are ignored.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(frequent_pre_tokens(docs, tokenizer, text_col, sample_docs))

    def apply(batches):
        count = shared.value.count
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf["_id"], "n_bytes": pdf["_bytes"], "n_tokens": [count(t) for t in pdf["_text"]]})

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    text = whole_text(text_col)
    picked = docs.select(F.col(id_col).alias("_id"), F.octet_length(text).cast("bigint").alias("_bytes"), text.alias("_text"))
    counted = map_rows(picked, apply, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
