"""Token counts of a unigram vocabulary: count-only Viterbi over Aho-Corasick matches.

The vocabulary is the pieces and scores of a public sentencepiece file, read as a unigram
model: spaces become the word mark, a mark is put before a text that has none, and the
segmentation of greatest total score is taken. An Aho-Corasick automaton enumerates all
pieces ending at each character; dynamic programming carries the best score and the
number of tokens on that path, no back pointers. Ties follow the tokenizer exactly:
starts are tried from left to right and only a greater score replaces one. A character
that is no piece costs the least score less 10 and counts its UTF-8 bytes (byte fallback).

No piece has a mark after another character, so a text falls apart before marks, and
scores are whole numbers, exact in floating point: counts add up over the parts. Parts
are kept in a bounded cache, as words repeat.

Cases: null and empty texts have 0 tokens. Repeated rows and null ids give a row each.
Other columns are not used.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muxlake.llm.common import texts

MARK = "▁"
PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter(dict):
    """part -> number of tokens, by Viterbi where it isn't known yet."""

    def __init__(self, pieces: list[tuple[str, float]], most: int = 1_000_000):
        import ahocorasick

        self.automaton, self.most = ahocorasick.Automaton(), most
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - 10

    def __missing__(self, part: str) -> int:
        best, count = [0.0] + [None] * len(part), [0] * (len(part) + 1)
        at, single = 0, False

        def unknown(end: int) -> None:
            score = best[end - 1] + self.unknown
            if best[end] is None or score > best[end]:
                best[end], count[end] = score, count[end - 1] + len(part[end - 1].encode())

        for i, (n, s) in self.automaton.iter(part):  # by end, the longest first: starts from left to right
            while at < i:  # positions are left in order
                at += 1
                if not single:
                    unknown(at)
                single = False
            score = best[i + 1 - n] + s
            if best[i + 1] is None or score > best[i + 1]:
                best[i + 1], count[i + 1] = score, count[i + 1 - n] + 1
            single |= n == 1
        while at < len(part):
            at += 1
            if not single:
                unknown(at)
            single = False
        if len(self) >= self.most:
            self.clear()
        self[part] = count[-1]
        return count[-1]

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            text = text.replace(" ", MARK)
            return sum(map(self.__getitem__, PART.findall(text if text[0] == MARK else MARK + text)))
        return sum(map(self.__getitem__, (MARK + text.replace(" ", f" {MARK}")).split(" ")))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row."""

    def run(batches):
        counter = Counter(vocabulary(path))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(map(counter.tokens, texts(b["text"])), pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")
