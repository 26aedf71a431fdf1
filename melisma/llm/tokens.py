"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

The tokenizer is a byte-fallback BPE model in sentencepiece format with a dummy space in front. Its tokens never
cross from text into a following space or over a line end, so a text falls into segments (spaces, then other
characters) that are tokenised on their own. Within a segment the last token of every prefix follows from shorter
prefixes: among the vocabulary's pieces that end there, it is the one that is compatible with the last token of
the prefix before it, where two tokens are compatible if merging their joined characters gives back the two.
Counting along that chain gives the token count of every prefix.

The counts are stored for each document as one big-endian 32-bit number for each prefix length 0, 1, ... in code
points, so that plain column expressions look them up: questions on truncation and budgets need no tokenizer.

Each document is handled on its own (no shuffle); the caches of a Python worker are bounded by ``CACHE`` and ``PAIRS``.

Defined results: null and empty texts have the single count 0; repeated rows are kept; an empty input gives an
empty output; columns of the input named like the new ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from melisma.llm.memo import Memo
from melisma.session import ship_package

CACHE = 300_000
PAIRS = 300_000
#: Characters of text in one output batch.
BATCH_CHARS = 2_000_000
#: Below every score.
NONE = -1e30
SPACE = "▁"
MARKS = ".,;:!?*#$%&|"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Segments:
    """Counts at each prefix of a segment, as little-endian 32-bit numbers; kept in bounded caches."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = range(model.get_piece_size())
        self.score = {model.id_to_piece(i): model.get_score(i) for i in pieces if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.heads = {p[:i] for p in self.score for i in range(1, len(p) + 1)}
        self.glued = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.whole, self.runs, self.fits = Memo(self._whole, CACHE), Memo(self._run, CACHE), Memo(self._fits, PAIRS)

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether merging the joined characters, best score first and leftmost, never joins across the border."""
        left, right = pair
        if left[-1] + right[0] not in self.glued:
            return True
        score, parts, border = self.score, [*left, *right], len(left) - 1
        scores = [score.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > NONE:
            i = scores.index(best)
            if i == border:
                return False
            border -= i < border
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score.get(parts[i - 1] + parts[i], NONE)
            if i < len(scores):
                scores[i] = score.get(parts[i] + parts[i + 1], NONE)
        return len(parts) == 2

    def prefixes(self, segment: str) -> list[int]:
        """Token count of every prefix of length 1, 2, ...

        Starts rise, so of the compatible pieces that end at a place the longest is met first.
        """
        size = len(segment)
        last, count = [""] * (size + 1), [0] * (size + 1)
        score, heads, fits = self.score, self.heads, self.fits
        for start in range(size):
            before = last[start]
            if start and not before:  # a character outside the vocabulary falls back to its bytes
                before = last[start] = segment[start - 1]
                count[start] = count[start - 1] + len(before.encode())
            for end in range(start + 1, size + 1):
                piece = segment[start:end]
                if piece not in heads:
                    break
                if not last[end] and piece in score and (not start or fits[before, piece]):
                    last[end] = piece
                    count[end] = count[start] + 1
        if not last[size]:
            count[size] = count[size - 1] + len(segment[-1].encode())
        return count[1:]

    def _run(self, run: str) -> bytes:
        return np.array(self.prefixes(run), "<u4").tobytes()

    def _whole(self, segment: str) -> bytes:
        """Marks behind a word are counted alone if no piece has the word's last character and the mark side by side."""
        head = segment.rstrip(MARKS)
        cut = len(head)
        if not head or cut == len(segment) or segment[cut - 1 : cut + 1] in self.glued:
            return self.runs[segment]
        first, rest = self.runs[head], self.runs[segment[cut:]]
        before = np.frombuffer(first, "<u4", 1, len(first) - 4)
        return first + (np.frombuffer(rest, "<u4") + before).astype("<u4").tobytes()

    def of_text(self, text: str) -> np.ndarray:
        """Counts at prefix lengths 0 ... len(text)."""
        if not text:
            return np.zeros(1, "<u4")
        known = self.whole
        parts = SEGMENT.findall(SPACE + text.replace(" ", SPACE))
        inner = np.frombuffer(b"".join([known[p] for p in parts]), "<u4")
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        total = inner[np.cumsum(size) - 1]
        counts = inner + np.repeat(np.cumsum(total) - total, size).astype("<u4")
        counts[0] = 0
        return counts


_READY: dict[str, Segments] = {}


def segments(model_file: str) -> Segments:
    if model_file not in _READY:
        _READY[model_file] = Segments(model_file)
    return _READY[model_file]


def prefix_counts(df: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_bytes`` (long, UTF-8) and ``prefix_tokens`` (binary, see above)."""
    ship_package(df.sparkSession)
    plain = df.drop("n_bytes", "prefix_tokens")
    schema = T.StructType([*plain.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("prefix_tokens", T.BinaryType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = segments(model_file)
        for batch in batches:
            texts, at = batch.column(batch.schema.get_field_index(text)), 0
            while at < batch.num_rows:
                sizes, found, chars, begin = [], [], 0, at
                while at < batch.num_rows and chars < BATCH_CHARS:
                    value = texts[at].as_py() or ""
                    sizes.append(len(value.encode()))
                    found.append(table.of_text(value).astype(">u4").tobytes())
                    chars += len(value)
                    at += 1
                part = batch.slice(begin, at - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], names=[*batch.schema.names, "n_bytes", "prefix_tokens"])

    return plain.mapInArrow(count, schema)


def tokens_at(prefix_tokens: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` code points; beyond the text's end, of the whole text."""
    last = (F.length(prefix_tokens) / 4 - 1).cast("int")
    at = F.greatest(F.lit(0), F.least(chars.cast("int"), last))
    return F.conv(F.hex(F.substring(prefix_tokens, at * 4 + 1, F.lit(4))), 16, 10).cast("long")


def n_tokens(prefix_tokens: Column) -> Column:
    """Tokens of the whole text."""
    return F.conv(F.hex(F.substring(prefix_tokens, F.length(prefix_tokens) - 3, F.lit(4))), 16, 10).cast("long")


def longest_prefix(prefix_tokens: Column, budget: Column) -> Column:
    """The most code points that a prefix of at most ``budget`` tokens can have."""
    ends = F.sequence(F.lit(0), (F.length(prefix_tokens) / 4 - 1).cast("int"))
    return F.array_max(F.filter(ends, lambda p: tokens_at(prefix_tokens, p) <= budget)).cast("long")


def truncated(text: Column, prefix_tokens: Column, budget: Column) -> Column:
    """The longest prefix of ``text`` within ``budget`` tokens."""
    return F.substring(F.coalesce(text, F.lit("")), F.lit(1), longest_prefix(prefix_tokens, budget).cast("int"))
