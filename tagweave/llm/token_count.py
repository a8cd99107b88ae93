"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at every
character. Dynamic programming carries the best score and the number of tokens to each
position; nothing is traced back. Scores add up in double precision and a later piece
replaces an earlier one only if it scores higher, so of equal scores the piece that starts
first wins: the rule of the unigram model of the ``tokenizers`` library. A character that
is no piece costs ten less than the lowest score and counts a token per UTF-8 byte, as byte
fallback writes it.

A space becomes the mark U+2581, and one mark is put in front of a text. Pieces carry marks
at their start only, so no piece reaches into the next word: words are scored on their own,
each distinct word once per task, in a store of bounded size. A line feed that is in no
piece cuts words in the same way.

Defined cases: null and empty texts have no tokens. Control, unknown and byte pieces are
never matched in a text. Every row of documents is counted by itself.
"""

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import text_slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
KEPT_WORDS = 400_000
KEPT_LENGTH = 64


def vocabulary(model_path: str) -> tuple[dict, float]:
    """Pieces with scores that may match in a text, and the lowest score of all pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    usable = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): model.get_score(i) for i in usable}, min(model.get_score(i) for i in ids)


class WordCounts(dict):
    """Tokens per word; a missing word is scored when it is looked up."""

    def __init__(self, pieces: dict, lowest: float):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.alone = {p for p in pieces if len(p) == 1}
        self.unknown = lowest - UNKNOWN_PENALTY
        inner = any(MARK in p.lstrip(MARK) for p in pieces)
        cut = r"\n" if not any("\n" in p for p in pieces) else ""
        # Words: marks and what follows up to the next mark. Whole texts if a piece spans words.
        self.words = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + (f"|{cut}" if cut else "") if not inner else r"(?s).+").findall

    def __missing__(self, word: str) -> int:
        count = self.viterbi(word)
        if len(word) > KEPT_LENGTH:
            return count
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = count
        return count

    def viterbi(self, word: str) -> int:
        """Tokens of the best segmentation."""
        scores = [0.0] + [float("-inf")] * len(word)
        counts = [0] * (len(word) + 1)
        strange = iter(())
        if not self.alone.issuperset(word):
            strange = (i for i, c in enumerate(word, 1) if c not in self.alone)
        unknown = next(strange, None)
        for end, (length, score) in self.automaton.iter(word):
            end += 1
            while unknown is not None and unknown < end:
                self.unknown_at(word, unknown, scores, counts)
                unknown = next(strange, None)
            score += scores[end - length]
            if score > scores[end]:
                scores[end] = score
                counts[end] = counts[end - length] + 1
        while unknown is not None:
            self.unknown_at(word, unknown, scores, counts)
            unknown = next(strange, None)
        return counts[-1]

    def unknown_at(self, word, end, scores, counts):
        """The character before ``end`` is no piece; it comes after all pieces that end there."""
        score = scores[end - 1] + self.unknown
        if score > scores[end]:
            scores[end] = score
            counts[end] = counts[end - 1] + len(word[end - 1].encode())

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.words(MARK + text.replace(" ", MARK))))


def token_counts(docs: DataFrame, model_path: str = None) -> DataFrame:
    """(doc_id, n_chars, n_tokens) of every row of documents."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        counts = WordCounts(*vocabulary(model_path))
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()),
                     pa.array([counts.text(t) for t in texts], pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
