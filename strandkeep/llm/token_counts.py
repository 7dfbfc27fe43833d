"""Token counts: the piece count of the best unigram segmentation, without building the pieces.

The vocabulary file's normal pieces and scores are read as a unigram model with byte fallback. Pieces
never hold a space mark after another character, so a text splits into segments (a run of spaces with
the characters after it) whose best paths add up; segments repeat, so each worker remembers their
counts. A new segment is scored by dynamic programming over the vocabulary matches that an Aho-Corasick
automaton lists: each position carries the best score of its prefix and that path's piece count.
Ties: the candidate with the longest last piece stays, because starts are tried in ascending order and
only a strictly better score replaces. A character that no piece covers costs the lowest score less 10
and counts as its UTF-8 bytes.
"""

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkeep.llm import common

#: The vocabulary the query uses; a parameter of count_tokens.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments remembered by a worker before it forgets all, and the longest one worth remembering.
CACHE_SEGMENTS, CACHE_CHARS = 1 << 19, 64
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]*")


def read_vocabulary(path: str) -> dict[str, float]:
    """The normal pieces of a sentencepiece file and their scores: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


class Counter:
    """Counts the pieces of texts under one vocabulary."""

    def __init__(self, pieces: dict[str, float]):
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space mark after another character; segments would not be independent")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.seen: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        """Tokens of a text; 0 for null and for the empty text."""
        if not text:
            return 0
        total, seen = 0, self.seen
        for segment in _SEGMENT.findall(SPACE + text.replace(" ", SPACE)):
            n = seen.get(segment)
            if n is None:
                n = self.best(segment)
                if len(segment) <= CACHE_CHARS:
                    if len(seen) >= CACHE_SEGMENTS:
                        seen.clear()
                    seen[segment] = n
            total += n
        return total

    def best(self, segment: str) -> int:
        """The piece count of the best path; starts of a position come in ascending order (longest piece first)."""
        n = len(segment)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        done = 0  # positions up to here are final
        matches = self.automaton.iter(segment)
        end, (length, value) = next(matches, (n, (0, 0.0)))
        for at in range(1, n + 1):
            best, count, single = None, 0, False
            ending = []
            while end == at - 1:
                ending.append((length, value))
                end, (length, value) = next(matches, (n, (0, 0.0)))
            for length_, value_ in sorted(ending, reverse=True):
                single |= length_ == 1
                candidate = score[at - length_] + value_
                if best is None or candidate > best:
                    best, count = candidate, pieces[at - length_] + 1
            if not single:
                candidate = score[done] + self.unknown
                if best is None or candidate > best:
                    best, count = candidate, pieces[done] + len(segment[done].encode("utf-8", "surrogatepass"))
            score[at], pieces[at], done = best, count, at
        return pieces[n]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with a column out (long): tokens of the whole text, 0 for null and empty. Repeated rows each keep theirs.

    A column that is named out already is replaced; others stay. Texts of any length are read whole, and an
    empty table gives an empty one.

    The vocabulary goes to the executors once, in the function's closure; its size doesn't depend on the data.
    """
    pieces = read_vocabulary(vocabulary)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(pieces)
        for batch in batches:
            yield pd.Series([counter.count(x) for x in batch], dtype="int64")

    common.tuned(docs.sparkSession)
    return docs.withColumn(out, counted(F.col(text)))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars (code points), n_tokens of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_tokens")


QUERIES = {"op1_token_counts": op1_token_counts}
