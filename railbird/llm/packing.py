"""Best-fit packing of tokenized documents into sequences, by hierarchical residual rounds.

Each task tokenizes its documents, cuts those longer than a sequence into pieces, and
packs its pieces best-fit, longest first.  Nearly full bins are done.  Underfull bins go
on as items: tasks are merged ``FAN_IN`` to one, the bins are packed best-fit into each
other, and so on up the tree.  A bin carries its pieces along, at most one for each
token, so rounds need no joins.  A task packs ``CHUNK`` items at a time, so neither a large
task nor items that don't combine need more memory.  Levels with more tasks than merging gives deal
bins by a hash.  The tree ends early once the open bins fill as many chunks as there are tasks: bins of
different chunks are then not tried together, and some sequences stay less full than they could be.  Every round is written to
the shared folder: a lost executor repeats its own tasks, never earlier rounds.

Defined results.  A missing text is empty and has the end token alone.  Rows that repeat an
id are packed each for itself.  An empty table gives an empty table.  Only documents longer than
a sequence are cut, into whole sequences and one rest.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import compress, islice, pairwise
from operator import not_
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.llm.common import batches, text_of
from railbird.session import written

CAPACITY = 2048
#: A bin with at most this room is done.
SLACK = 16
FAN_IN = 8
#: Items packed together in a task.
CHUNK = 100_000
#: Different words whose ids a worker remembers, in each of two generations.
REMEMBERED = 800_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

MEMBER = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"
BIN = "done boolean, node int, sequence_id bigint, size int, members array<struct<%s>>"


class WordIds:
    """Ids of a text by ``tokenizers``, words met before taken from memory.

    Valid for tokenizers that drop white space, cut the text into words before merging and
    mark a word's last token with a suffix, letters and punctuation being different words.
    Between blanks a text is cut freely.  Words of letters are asked for together; the suffix
    tells where each one's ids end.  Anything else is asked for alone.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        suffix = "</w>"
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.remembered, self.young, self.old = remembered, {}, {}

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, words: list[str]) -> None:
        parts = [words[i:i + 500] for i in range(0, len(words), 500)]
        coded = self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)
        for part, code in zip(parts, coded, strict=True):
            ids = np.array(code.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                raw, cuts = ids.tobytes(), [0, *(stops * 4).tolist()]
                self.young.update(zip(part, [raw[a:b] for a, b in pairwise(cuts)], strict=True))
            else:
                self.young.update((w, self._alone(w)) for w in part)

    def _letters(self, word: str) -> str:
        """The letters of a word of letters and ASCII punctuation behind them, in lower case if the word is ASCII; else the word."""
        letters = word.rstrip(PUNCTUATION)
        if not self._whole(letters):
            return word
        return letters.lower() if letters.isascii() else letters

    @staticmethod
    def _whole(word: str) -> bool:
        """Whether the word is letters alone, also once it is composed and in lower case."""
        return word.isalpha() and (word.isascii() or normalize("NFC", word).lower().isalpha())

    def _found(self, word: str) -> bytes:
        ids = self.young.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                ids = self._alone(word)
            self.young[word] = ids
        return ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        texts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        met = [list(map(young.get, words)) for words in texts]
        lacks = [list(compress(range(len(ids)), map(not_, ids))) for ids in met]
        new = set().union(*(map(words.__getitem__, at) for words, at in zip(texts, lacks, strict=True)))
        known = [w for w in new if w in old]
        young.update((w, old[w]) for w in known)
        new.difference_update(known)
        young[""] = b""
        plain = [w for w in new if w.isalpha() and w.islower() and w.isascii()]
        parts = {w: self._letters(w) for w in new.difference(plain)}
        asked = {b for b in parts.values() if b not in young and b not in old and self._whole(b)}
        self._together(list(asked.union(plain)))
        for word, letters in parts.items():
            if word not in young:
                tail = word[len(letters):]
                young[word] = self._found(letters) + self._found(tail) if tail else self._found(letters)
        for words, ids, at in zip(texts, met, lacks, strict=True):
            for i in at:
                ids[i] = young[words[i]]
            yield b"".join(ids)


_ENCODERS: dict[str, WordIds] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoder(path: str | None) -> WordIds:
    path = path or default_tokenizer()
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def _pieces(source: Iterator[pa.RecordBatch], path: str | None, capacity: int) -> Iterator[tuple]:
    encoder = _encoder(path)
    for batch in source:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids = part.column(0).to_pylist()
            for doc_id, raw in zip(ids, encoder.encode(part.column(1).to_pylist()), strict=True):
                raw += b"\0\0\0\0"
                n = len(raw) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    cut = raw[4 * start:4 * (start + capacity)]
                    yield doc_id, piece, start, len(cut) // 4, zlib.crc32(cut)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit, longest first: the items of each bin.

    Open bins are kept by their room; a number with one bit per room finds the least room that is enough.
    """
    rooms: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    bins, open_ = [], 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        fits = open_ >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            held = rooms[room].pop()
            if not rooms[room]:
                open_ ^= 1 << room
        else:
            room, held = capacity, []
            bins.append(held)
        held.append(i)
        left = room - size
        if not rooms[left]:
            open_ |= 1 << left
        rooms[left].append(held)
    return bins


def _packed(items: Iterator[tuple[int, int, list[tuple]]], schema: pa.Schema, level: int, last: bool, capacity: int, slack: int, chunk: int):
    """Rows of ``BIN`` out of (node, size, members) items; a bin has the node of its chunk's first item."""
    task = TaskContext.get().partitionId()
    first = (level << 57) + (task << 33)

    def rows() -> Iterator[tuple]:
        n = 0
        while part := list(islice(items, chunk)):
            sizes, node = [p[1] for p in part], part[0][0]
            for held in best_fit(sizes, capacity):
                size, n = sum(sizes[i] for i in held), n + 1
                yield last or size >= capacity - slack, node, first + n, size, [m for i in held for m in part[i][2]]

    yield from batches(rows(), schema, 1024)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         capacity: int = CAPACITY, slack: int = SLACK, fan_in: int = FAN_IN, chunk: int = CHUNK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is a path that every executor has; the default is the public word tokenizer's.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(docs, text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema_text = BIN % ", ".join(f"{n}:{t}" for n, t in (x.split() for x in MEMBER.format(id=id_type).split(", ")))
    arrow = _arrow_schema(docs.sparkSession, schema_text)

    def first(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        pieces = ((node, p[3], [p]) for p in _pieces(source, tokenizer, capacity))
        yield from _packed(pieces, arrow, 0, False, capacity, slack, chunk)

    def again(level: int, last: bool) -> Callable:
        def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bins = ((n, s, [tuple(m.values()) for m in ms]) for b in source for n, s, ms in zip(
                *(c.to_pylist() for c in b.columns), strict=True))
            yield from _packed(bins, arrow, level, last, capacity, slack, chunk)

        return make

    level, found, nodes = 0, written(rows.mapInArrow(first, schema_text)), None
    done = []
    while True:
        done.append(found.where("done"))
        open_ = found.where("not done")
        left, top = open_.agg(F.count(F.lit(1)), F.max("node")).first()
        if not left:
            break
        nodes = nodes or top + 1
        merged = max(-(-nodes // fan_in), -(-left // chunk))
        last = merged == 1 or merged >= nodes
        level, level_nodes, nodes = level + 1, nodes, merged
        # Merging alone has too few different nodes if open bins ask for more tasks.
        if merged == -(-level_nodes // fan_in):
            parent, by = F.floor(F.col("node") / fan_in), "node"
        else:
            parent, by = F.pmod(F.xxhash64("sequence_id"), F.lit(merged)), "sequence_id"
        dealt = open_.withColumn("node", parent.cast("int")).repartition(merged, by)
        found = written(dealt.select("node", "size", "members").mapInArrow(again(level, last), schema_text))

    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    lengths = F.transform("members", lambda m: m["length"])
    starts = F.transform(
        F.sequence(F.lit(1), F.size("members")),
        lambda i: F.aggregate(F.slice(lengths, 1, i - 1), F.lit(0).cast("long"), lambda a, x: a + x))
    out = out.select("sequence_id", F.explode(F.arrays_zip(F.col("members").alias("m"), starts.alias("offset"))).alias("z"))
    return out.select("z.m.*", "sequence_id", F.col("z.offset").alias("offset"))


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_best_fit_packing": op5}
ORACLE: dict[str, str] = {}
