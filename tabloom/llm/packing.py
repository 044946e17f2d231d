"""Token sequences of a fixed size by bounded-space online packing.

A document is its token ids and one id at its end. Documents of more than SIZE ids give full sequences
from their front; what is left, less than SIZE, is an item. Every task keeps at most WINDOWS open
windows: an item goes to the fullest one in which it fits (best fit), else it opens a new one. When
no more may be opened, the fullest window is emitted, filled up by the front of the item, and the rest
of the item is placed in turn. So an emitted sequence holds exactly SIZE ids and a document is cut
only where nothing fits.

At its end a task leaves its open windows' pieces. They are packed again the same way, MERGE
tasks' leftovers in one task, round by round until one task is left; every round leaves at most
1 / MERGE of the windows before, so the leftovers (WINDOWS * SIZE ids a task) never gather. The last
windows are filled from one another, and what then remains is cut into sequences whose lengths are
powers of two, which need no padding. The whole corpus so gets no padding at all.

Ids come from a tokenizer file, a path that is valid on every worker. With the default one, text between
spaces and line feeds never shares an id with its neighbours, so words are encoded once and kept in a
bounded cache, Latin ones by their parts. ``plain=True`` gives whole texts to the library, for any other tokenizer.

Defined results: a null or empty text is the end id alone. A null id is carried through. Rows with the
same id are packed one by one. An empty table gives no rows. Extra columns are ignored. One text and its
ids are in memory at once.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.support import load, query, stage_table

SIZE, END = 2048, 1
WINDOWS, MERGE = 64, 64
CACHE, LONG = 400_000, 64
# Without blanks and controls; lower case stays in the range and is the same with and without context.
LAST_LATIN = 0x17F
_LATIN = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]+")
HELD_BYTES = 4 << 20
_PLACE_BITS = 33


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _units() -> re.Pattern:
    """What the tokenizer takes apart before merging, for words of Latin text: see _LATIN."""
    latin = [chr(c) for c in range(ord("!"), LAST_LATIN + 1) if _LATIN.fullmatch(chr(c))]
    of = lambda kind: "".join(map(re.escape, (c for c in latin if unicodedata.category(c)[0] == kind)))
    letters, numbers = of("L"), of("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+")


class _Words(dict):
    """Packed ids of the text between blanks; long ones are not kept.

    A word of Latin text is lower-cased and cut as the tokenizer's own rules cut it, and its parts are merged by
    the tokenizer's model and kept as well; every other word goes through the whole library.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.units: dict[str, bytes] = {}
        self.cut = _units().findall
        printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        # The byte alphabet: other bytes stand behind the printable ones, from 256 on.
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        found = self.units.get(unit)
        if found is None:
            letters = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.alphabet)
            found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
            if len(self.units) >= CACHE:
                self.units.clear()
            self.units[unit] = found
        return found

    def __missing__(self, word: str) -> bytes:
        if _LATIN.fullmatch(word) and "<|" not in word and len(word) <= LONG:
            packed = b"".join(map(self._unit, self.cut(word.lower())))
        else:
            packed = self.plain(word)
        if len(word) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    from tokenizers import Tokenizer

    return _Words(Tokenizer.from_file(path))


_FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
    ("offset", pa.int64()), ("task", pa.int64()), ("place", pa.int64()),
]
_SCHEMA = pa.schema(_FIELDS)
_DDL = "doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, task bigint, place bigint"


class _Rows:
    """Output rows, given away as batches of about HELD_BYTES."""

    def __init__(self, sequences: int, task: int):
        self.columns = [[] for _ in _FIELDS]
        self.size, self.task, self.next = 0, task, sequences

    def add(self, piece, sequence: int | None, offset: int | None, place: int | None) -> None:
        doc_id, start, ids, tokens = piece
        for column, value in zip(self.columns, (doc_id, start, ids, tokens, sequence, offset, self.task, place), strict=True):
            column.append(value)
        self.size += len(ids)

    def sequence(self, pieces: list) -> None:
        at = 0
        for piece in pieces:
            self.add(piece, self.next, at, None)
            at += len(piece[2]) // 4
        self.next += 1

    def full(self) -> bool:
        return self.size >= HELD_BYTES

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, _SCHEMA, strict=True)], schema=_SCHEMA)
        self.columns, self.size = [[] for _ in _FIELDS], 0
        return out


def _cut(piece, n: int):
    """The first n ids of a piece and the rest."""
    doc_id, start, ids, tokens = piece
    return (doc_id, start, ids[: 4 * n], tokens), (doc_id, start + n, ids[4 * n :], tokens)


class Windows:
    """At most ``limit`` open windows of ``size`` ids; ``emit`` takes the pieces of a full one."""

    def __init__(self, size: int, limit: int, emit):
        self.size, self.limit, self.emit = size, limit, emit
        self.room: list[tuple[int, int]] = []  # (free ids, window), least room first
        self.pieces: dict[int, list] = {}
        self.opened = 0

    def _put(self, window: int, room: int, piece) -> None:
        self.pieces[window].append(piece)
        room -= len(piece[2]) // 4
        if room:
            insort(self.room, (room, window))
        else:
            self.emit(self.pieces.pop(window))

    def place(self, piece) -> None:
        doc_id, start, ids, tokens = piece
        n = len(ids) // 4
        whole = n - n % self.size
        for at in range(0, whole, self.size):
            self.emit([(doc_id, start + at, ids[4 * at : 4 * (at + self.size)], tokens)])
        if whole == n:
            return
        if whole:
            piece, n = (doc_id, start + whole, ids[4 * whole :], tokens), n - whole
        at = bisect_left(self.room, (n, -1))
        if at == len(self.room) and len(self.room) >= self.limit:
            room, window = self.room.pop(0)  # the fullest
            front, piece = _cut(piece, room)
            self._put(window, room, front)
            n -= room
            at = bisect_left(self.room, (n, -1))
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            room, window = self.size, self.opened
            self.pieces[window] = []
            self.opened += 1
        self._put(window, room, piece)

    def left(self) -> Iterator[list]:
        """Pieces of the open windows, fullest first."""
        for _, window in self.room:
            yield self.pieces[window]

    def close(self) -> None:
        """Fill the open windows from one another; the remainder becomes sequences of powers of two."""
        held: list = []
        size = 0
        for pieces in self.left():
            for piece in pieces:
                n = len(piece[2]) // 4
                if size + n >= self.size:
                    front, piece = _cut(piece, self.size - size)
                    self.emit([*held, front])
                    held, size, n = [], 0, len(piece[2]) // 4
                if n:
                    held.append(piece)
                    size += n
        while size:
            n = 1 << size.bit_length() - 1
            part, taken = [], 0
            while taken < n:
                piece = held.pop(0)
                m = len(piece[2]) // 4
                if taken + m > n:
                    piece, rest = _cut(piece, n - taken)
                    held.insert(0, rest)
                    m = n - taken
                part.append(piece)
                taken += m
            self.emit(part)
            size -= n


def _packer(items, size: int, windows: int, level: int, last: bool):
    """A task's packing: whole sequences, and the pieces of its open windows without a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rows = _Rows((level << 57) + (task << _PLACE_BITS), task)
        open_windows = Windows(size, windows, rows.sequence)
        for piece in items(batches):
            open_windows.place(piece)
            if rows.full():
                yield rows.batch()
        if last:
            open_windows.close()
        else:
            for place, piece in enumerate(p for pieces in open_windows.left() for p in pieces):
                rows.add(piece, None, None, place)
        yield rows.batch()

    return run


def _documents(path: str, end: int, plain: bool):
    closing = end.to_bytes(4, "little")

    def items(batches):
        words = _words(path)
        encode = words.plain if plain else words.encode
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + closing
                yield doc_id.as_py(), 0, ids, len(ids) // 4

    return items


def _leftovers(batches):
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")], strict=True)


def pack(
    df: DataFrame, size: int = SIZE, windows: int = WINDOWS, merge: int = MERGE, end: int = END, tokenizer: str | None = None,
    plain: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id and offset of every piece.

    ``ids`` are packed little-endian unsigned 32-bit numbers; ``size`` is a power of two.
    """
    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    first = _packer(_documents(tokenizer or default_tokenizer(), end, plain), size, windows, 0, False)
    packed = stage_table(slim.mapInArrow(first, _DDL), "packed")
    out = packed.filter("sequence_id IS NOT NULL")
    level = 0
    while True:
        left = packed.filter("sequence_id IS NULL")
        tasks = (left.agg(F.max("task")).first()[0] or 0) + 1
        level, groups = level + 1, -(-tasks // merge)
        dealt = left.withColumn("group", F.floor(F.col("task") / merge).cast("int")).repartitionById(groups, F.col("group"))
        dealt = dealt.sortWithinPartitions("task", "place").select("doc_id", "start", "ids", "doc_tokens")
        packed = stage_table(dealt.mapInArrow(_packer(_leftovers, size, windows, level, groups == 1), _DDL), "packed")
        out = out.unionByName(packed.filter("sequence_id IS NOT NULL"))
        if groups == 1:
            break
    length = (F.octet_length("ids") / 4).cast("bigint").alias("length")
    return out.select("doc_id", "start", length, "ids", "doc_tokens", "sequence_id", "offset")


@query("op12_packing")
def op12_packing(spark, sf_dir):
    pieces = pack(load(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
