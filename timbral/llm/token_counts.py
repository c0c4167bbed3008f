"""Token counts by a two-tier lookup of pre-token lengths, without any shuffle.

A byte-level BPE splits a text into pre-tokens and encodes each by itself, so a
text's count is the sum over its pre-tokens' counts.  Texts are cut where that
sum is safe: before a single space, around white-space runs of three and more,
and around the added tokens.  The first tier is a broadcast table with the
lengths of the vocabulary's own words.  They are the frequent pre-tokens of the
corpus that the tokenizer was trained on, and stand for those of these
documents: counting these would be a second pass over all texts to find the same
words, and counts are the same whichever words the table has.  Its size is bound
by the vocabulary.  What it misses is encoded by the tokenizer and kept in a
cache of bounded bytes that a Python worker process keeps from task to task.
"""

from __future__ import annotations

import functools
import os
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from timbral.llm.shared import slices

#: Bytes of a worker's second tier, about; when it is full it starts anew.
CACHE = 64 << 20
#: Longer pieces, as texts without spaces give them, are encoded each time and never kept.
MOST_KEPT = 64
_SLICE = 1 << 20
_SPACES = " \t\n\x0b\x0c\r\x85\xa0  -     　"
_RUN = re.compile(f"([{_SPACES}]{{3,}})")
_RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def frequent_lengths(path: str) -> dict[str, int]:
    """Token counts of the vocabulary's words, with and without the space that precedes them in a text."""
    tokenizer = Tokenizer.from_file(path)
    found = sorted({tokenizer.decode([i]) for i in tokenizer.get_vocab(with_added_tokens=False).values()})
    plain = [w for w in found if w and "�" not in w and not re.search(r"\s", w.strip(" ")) and w.count(" ") <= 1]
    return dict(zip(plain, (len(e.ids) for e in tokenizer.encode_batch(plain, add_special_tokens=False)), strict=True))


class Counter:
    """Counts tokens of whole texts as the tokenizer of a file would."""

    def __init__(self, path: str, frequent: dict[str, int]) -> None:
        self.tokenizer, self.frequent = Tokenizer.from_file(path), frequent
        self.lengths = dict(frequent)  # both tiers
        self.held = 0
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """How many added tokens text has, and pieces whose counts add up to the rest."""
        extra, out = 0, []
        for part in [text] if self.added is None or not self.added.search(text) else self.added.split(text):
            extra += 1
            runs = _RUN.split(part)
            lead = ""
            for k in range(0, len(runs), 2):
                plain = lead + runs[k]
                lead = ""
                if plain:
                    first, *rest = plain.split(" ")
                    if first:
                        out.append(first)
                    out += [" " + w for w in rest]
                if k + 1 < len(runs):
                    run = runs[k + 1]
                    if k + 2 == len(runs) - 1 and not runs[k + 2]:
                        out.append(run)  # the text ends with the run: one pre-token
                    else:  # its last character goes with what follows
                        out.append(run[:-1])
                        lead = run[-1]
        return extra - 1, out

    def _encoded(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for a in range(0, len(pieces), 10_000) for e in self.tokenizer.encode_batch_fast(pieces[a : a + 10_000], add_special_tokens=False)]

    def count(self, texts: list[str | None]) -> list[int]:
        found = [self.pieces(t) if t else (0, []) for t in texts]
        out, new = [], set().union(*(words for _, words in found)).difference(self.lengths)
        long = {w for w in new if len(w) > MOST_KEPT}
        new = sorted(new - long)
        self.held += sum(map(len, new)) * 2 + 150 * len(new)
        self.lengths |= zip(new, self._encoded(new), strict=True)
        for extra, words in found:
            if long:
                away = [w for w in words if w in long]
                extra += sum(self._encoded(away))
                words = [w for w in words if w not in long] if away else words
            out.append(extra + sum(map(self.lengths.__getitem__, words)))
        if self.held > CACHE:
            self.lengths, self.held = dict(self.frequent), 0
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The worker process's counter for a tokenizer file; its first tier comes with the first task."""
    return Counter(path, {})


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row, whole texts throughout.

    docs: doc_id, text; other columns are ignored.  path: a tokenizer file of the
    tokenizers library with byte-level pre-tokens, readable on every machine.
    Counts are those of encode(text, add_special_tokens=False): added tokens'
    strings in a text count as these tokens, nothing is cut or padded.  A null
    or empty text has 0 bytes and 0 tokens.  Repeated rows are counted each; a
    null doc_id stays null.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(path))

    def count(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        own = counter(path)
        if not own.frequent:
            own.frequent = table.value
            own.lengths = dict(own.frequent)
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                texts = part.column("text")
                n = pa.array(own.count(texts.to_pylist()), pa.int64())
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, _RESULT)
