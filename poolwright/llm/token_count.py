"""Token counts under a unigram vocabulary, without making the tokens.

The tokenizer splits a text before every space (written as U+2581, one more in front)
and takes, for each such word, the segmentation with the largest sum of piece scores.
Only the number of pieces is wanted, so the dynamic programme carries two numbers per
place: the best score and the pieces it took. An Aho-Corasick automaton names all
vocabulary pieces that end at a place.

Ties follow the tokenizer: candidates for a place are tried from the earliest start on,
and a later one replaces it only if strictly better. A character that is no piece costs
the lowest score less ten, and counts as the bytes of its UTF-8 form (byte fallback).

Words repeat, so each worker remembers counts of words; what it holds is bounded.

Defined cases: a null or empty text has no tokens; other columns ride along; repeated
rows are counted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poolwright.llm.common import small_batches, table

MARK = "▁"
PENALTY = 10.0
REMEMBERED = 500_000
LONGEST = 64


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a vocabulary file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of a text."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.words: dict[str, tuple[int, int]] = {}
        self.older: dict[str, tuple[int, int]] = {}

    def word(self, word: str) -> tuple[int, int]:
        """(pieces, characters that are no piece) of one word with its mark."""
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        took, missed = [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        at, ending = 0, []
        matches = self.automaton.iter(word)
        match = next(matches, None)
        for end in range(1, n + 1):
            ending.clear()
            while match is not None and match[0] == end - 1:
                ending.append(match[1])
                match = next(matches, None)
            ending.sort(key=lambda m: -m[0])  # earliest start first
            single = False
            for length, score in ending:
                at = end - length
                candidate = score + best[at]
                if best[end] is None or candidate > best[end]:
                    best[end], took[end], missed[end] = candidate, took[at] + 1, missed[at]
                single = single or length == 1
            if not single:
                at = end - 1
                candidate = self.unknown + best[at]
                if best[end] is None or candidate > best[end]:
                    size = len(word[at].encode("utf-8", "replace"))
                    best[end], took[end], missed[end] = candidate, took[at] + size, missed[at] + 1
        return took[n], missed[n]

    def text(self, text: str) -> tuple[int, int]:
        if not text:
            return 0, 0
        pieces = unknown = 0
        if not text.startswith((" ", MARK)):
            text = " " + text
        words = text.replace(MARK, " ").split(" ")
        for word in words[1:]:  # what comes before the first mark is empty
            got = self.words.get(word)
            if got is None:
                got = self.older.get(word) or self.word(MARK + word)
                if len(word) <= LONGEST:
                    if len(self.words) >= REMEMBERED // 2:
                        self.older, self.words = self.words, {}
                    self.words[word] = got
            pieces += got[0]
            unknown += got[1]
        return pieces, unknown


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(vocabulary(path))
    return _loaded[path]


def token_counts(text: Column, vocabulary_path: str) -> Column:
    """A struct of n_tokens and n_unknown (characters that are no piece) for each text."""

    @F.arrow_udf("struct<n_tokens:bigint,n_unknown:bigint>")
    def counted(texts: pa.Array) -> pa.Array:
        c = counter(vocabulary_path)
        rows = np.array([c.text(t.as_py()) for t in texts], np.int64).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["n_tokens", "n_unknown"])

    return counted(text)


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.withColumn("_found", token_counts(F.col("text"), public_tokenizers.path("piece_bpe_32k.model")))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return found.select("doc_id", size.alias("n_bytes"), "_found.n_tokens", "_found.n_unknown")
