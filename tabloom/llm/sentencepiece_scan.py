"""SentencePiece encoding and decoding by a max-plus scan over boundary states.

A text is a path of pieces. A step from piece p to piece q weighs 0 if the model's own merging of
p's text and q's text gives back [p, q], else minus infinity. A path of weight 0 is the model's
byte-pair encoding, and it is the only one, so the best path of the max-plus product is what
the SentencePiece library returns. At each position at most one piece can end such a path.

A text of more than CHUNK characters is cut into chunks. The state at a cut is the piece that
covers or touches it and how many of its characters lie beyond. Each chunk gives, on its own, a
transfer matrix of states at its start to states at its end (its finite entries only). The
matrices of a text multiply associatively; prefix products from the left and the state forced by
the end give the state at every cut, and each chunk is traced back alone between its two states. A
matrix has at most some dozens of rows, and a text at most 2 GB / CHUNK chunks, as a cell cannot
be larger. Chunks of one text are spread over all tasks.

Where no piece of the model holds two neighbouring characters, every path has a step between them. So
runs of non-spaces with the spaces before them, and inside these runs of letters, are segments of
their own (the model file tells which characters do so), whose encodings are kept in a bounded cache.

Model conventions: a space becomes U+2581 and one is put in front; U+2581 itself reads as a
space; characters without a piece become their UTF-8 bytes. The model file is a parameter, a
path that is valid on every worker.

Defined results: a null text has null ids and 0 tokens; an empty one has no ids. Repeated rows are
encoded one by one. Input columns are kept; ``ids`` and ``n_tokens`` replace columns of that name.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.support import load, query, stage_table

CHUNK = 1 << 15
CACHE = 500_000
TOGETHER = 1 << 20
SPACE = "▁"
START = -1
_BREAK = re.compile(f"[^{SPACE}](?={SPACE})")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def segment_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Segments of a marked text, by the pairs of characters that ``pieces`` hold.

    Inner characters are those that only inner ones follow in a piece, so a segment ends behind a run of
    them; it also begins at such a run, unless the character before is one that an inner one follows.
    """
    follows: dict[str, set[str]] = {}
    for piece in pieces:
        for c in piece:
            follows.setdefault(c, set())
        for a, b in zip(piece, piece[1:], strict=False):
            follows[a].add(b)
    inner = {c for c in follows if c.isalpha()}
    while outside := {c for c in inner if not follows[c] <= inner}:
        inner -= outside
    if not inner:
        return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
    before = {c for c in follows if c not in inner and c != SPACE and not follows[c].isdisjoint(inner)}
    run = f"[{re.escape(''.join(sorted(inner)))}]+"
    other = f"[^{SPACE}{run[1:-2]}]"
    joined = f"(?:{other}*[{re.escape(''.join(sorted(before)))}])?" if before else ""
    return re.compile(f"{SPACE}*{joined}{run}|{SPACE}*{other}+|{SPACE}+")


class _Segments(dict):
    """Encodings of segments as packed int32; long ones are not kept."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, segment: str) -> bytes:
        return next(self.model.encode_segments([segment]))


class Model:
    """Pieces and scores of a model file, with the step weights of the lattice."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.text: list[str] = []
        for i in range(size):
            piece = sp.id_to_piece(i)
            self.text.append(piece)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.id[piece], self.score[piece] = i, sp.get_score(i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.id))
        self.pattern = segment_pattern(self.id)
        self.begins = {piece[:n] for piece in self.id for n in range(1, len(piece) + 1)}
        self.nodes: dict[str, tuple[str, tuple[tuple[int, int], ...]]] = {}
        self.steps: dict[tuple[int, int], bool] = {}
        self.segments = _Segments(self)

    def merged(self, text: str) -> list[str]:
        """The merges of a short text, best score first, leftmost on ties."""
        parts = list(text)
        while True:
            pairs = [(-self.score[m], i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in self.score]
            if not pairs:
                return parts
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def steps_to(self, p: int, q: int) -> bool:
        """Whether the step from piece p to piece q has weight 0. Ids from -2 down are single unknown characters."""
        found = self.steps.get((p, q))
        if found is None:
            a = [] if p < 0 else [self.text[p]]
            b = [] if q < 0 else [self.text[q]]
            if a and b:
                found = self.merged(a[0] + b[0]) == a + b
            else:
                found = all(self.merged(x) == [x] for x in a + b)
            if len(self.steps) >= CACHE:
                self.steps.clear()
            self.steps[p, q] = found
        return found

    def ends_at(self, text: str) -> tuple[str, tuple[tuple[int, int], ...]]:
        """The longest end of ``text`` that a piece begins with, and size and id of the pieces that end there.

        The shortest piece comes first; a character without a piece stands for itself.
        """
        tail = text
        while tail and tail not in self.begins:
            tail = tail[1:]
        ends = [(n, q) for n in range(1, len(tail) + 1) if (q := self.id.get(tail[-n:])) is not None]
        if not ends or ends[0][0] > 1:
            ends.insert(0, (1, -2 - ord(text[-1])))
        if len(self.nodes) >= CACHE:
            self.nodes.clear()
        self.nodes[text] = tail, tuple(ends)
        return self.nodes[text]

    def _piece(self, s: str) -> int | None:
        found = self.id.get(s)
        return -1 - ord(s) - 1 if found is None and len(s) == 1 else found

    def reach(self, s: str, start: int, state: int, stop: int) -> dict[int, tuple[int, int]]:
        """Position -> (last piece, its start) for the paths from ``start`` with ``state`` before it.

        Pieces start before ``stop``; they may end beyond it.
        """
        last: dict[int, tuple[int, int]] = {start: (state, -1)}
        for end in range(start + 1, min(len(s), stop - 1 + self.longest) + 1):
            for at in range(min(end, stop) - 1, max(start, end - self.longest) - 1, -1):
                if at in last and (q := self._piece(s[at:end])) is not None and self.steps_to(last[at][0], q):
                    last[end] = (q, at)
                    break
        return last

    def trace(self, s: str, last: dict[int, tuple[int, int]], end: int) -> list[int]:
        """Ids of the path to ``end``, without the piece before its start."""
        out: list[int] = []
        while last[end][1] >= 0:
            q, at = last[end]
            if q < -1:
                out += [self.byte_id[b] for b in reversed(s[at].encode("utf-8", "surrogatepass"))]
            else:
                out.append(q)
            end = at
        return out[::-1]

    def encode_segments(self, segments: list[str]) -> Iterator[bytes]:
        """Packed ids of sorted segments: as ``reach`` and ``trace``, but neighbours share the paths
        of their common prefix. The order of the trials is free; last pieces are mostly short.
        """
        nodes, steps = self.nodes.get, self.steps.get
        before, last, came, tails = "", [START], [0], [""]
        for segment in segments:
            shared, most = 0, min(len(before), len(segment))
            while shared < most and before[shared] == segment[shared]:
                shared += 1
            del last[shared + 1 :], came[shared + 1 :], tails[shared + 1 :]
            before, tail, end = segment, tails[-1], shared
            for char in segment[shared:]:
                tail, ends = nodes(tail + char) or self.ends_at(tail + char)
                end += 1
                for size, q in ends:
                    p = last[end - size]
                    ok = steps((p, q))
                    if ok or (ok is None and self.steps_to(p, q)):
                        break
                last.append(q)
                came.append(end - size)
                tails.append(tail)
            out, end = [], len(segment)
            while end:
                q, at = last[end], came[end]
                if q >= 0:
                    out.append(q)
                else:
                    out += [self.byte_id[b] for b in reversed(segment[at].encode("utf-8", "surrogatepass"))]
                end = at
            out.reverse()
            yield array("i", out).tobytes()

    def encode_marked(self, texts: list[str]) -> list[bytes]:
        """Packed ids of marked texts that begin and end at segment ends; new segments are encoded together."""
        parts = [self.pattern.findall(t) for t in texts]
        seen = {x for x in set(chain.from_iterable(parts)) if len(x) <= 64}
        new = [x for x in seen if x not in self.segments]
        if len(self.segments) + len(new) > CACHE:
            # Those of the texts at hand are the frequent ones and stay.
            kept = {x: self.segments[x] for x in seen.difference(new)}
            self.segments.clear()
            self.segments.update(kept)
        new.sort()
        self.segments.update(zip(new, self.encode_segments(new), strict=True))
        return [b"".join(map(self.segments.__getitem__, p)) for p in parts]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts."""
        return self.encode_marked([marked(t) for t in texts])

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        return self.encode_texts([text])[0]

    def decode(self, ids) -> str:
        text = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_MODELS: dict[str, Model] = {}


def model_at(path: str) -> Model:
    """One model per worker process."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def readable(text: str) -> str:
    """What decoding gives back: U+2581 reads as a space."""
    return text.replace(SPACE, " ")


# --- whole texts -----------------------------------------------------------------------------


def _encoder(path: str):
    """Ids of the last column, and whether they decode to it; small batches leave early."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)

        def finish(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
            packed = model.encode_texts([t or "" for t in texts])
            nulls = [t is None for t in texts]
            ids = _lists(b"".join(packed), [len(x) // 4 for x in packed], nulls)
            same = [t is None or model.decode(memoryview(x).cast("i")) == readable(t) for t, x in zip(texts, packed, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, pa.array(same)], names=[*batch.schema.names[:-1], "ids", "same"])

        for batch in batches:
            start, texts, chars = 0, [], 0
            for i, x in enumerate(batch.column(batch.num_columns - 1)):
                texts.append(x.as_py())
                chars += len(texts[-1] or "")
                if chars >= TOGETHER:
                    yield finish(batch.slice(start, len(texts)), texts)
                    start, texts, chars = i + 1, [], 0
            if texts:
                yield finish(batch.slice(start), texts)

    return run


def _lists(packed: bytes, sizes: list[int], nulls: list[bool]) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(packed, dtype="<i4")), mask=pa.array(nulls, pa.bool_()))


# --- giant texts -----------------------------------------------------------------------------

_CHUNKS = "row bigint, chunk int, head int, size int, final boolean, part string"


def _cut(longest: int, chunk: int):
    """Chunks of the marked text with ``longest`` characters of context on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = marked(text.as_py())
                for n, at in enumerate(range(0, len(s), chunk)):
                    head = min(at, longest)
                    part = s[at - head : at + chunk + longest]
                    size = min(chunk, len(s) - at)
                    columns = [[row], [n], [head], [size], [at + chunk >= len(s)], [part]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()), strict=True)],
                        names=["row", "chunk", "head", "size", "final", "part"],
                    )

    return run


def states_at(model: Model, s: str, cut: int) -> list[tuple[int, int]]:
    """Pieces that cover or touch ``cut`` from the left, with the characters they have beyond it."""
    found = []
    for beyond in range(model.longest):
        for size in range(beyond + 1, model.longest + 1):
            a, b = cut + beyond - size, cut + beyond
            if a >= 0 and b <= len(s) and (q := model._piece(s[a:b])) is not None:
                found.append((q, beyond))
    return found


def _segment_starts(s: str, start: int, stop: int) -> tuple[int, int] | None:
    """First and last position in [start, stop) where a segment begins: every path has a step there."""
    found = [start + m.start() + 1 for m in _BREAK.finditer(s[start:stop])]
    return (found[0], found[-1]) if found else None


def transfer(model: Model, chunk: int, head: int, size: int, part: str) -> list[tuple[int, int, int, int]]:
    """Finite entries of a chunk's matrix: (piece, beyond) at its start to (piece, beyond) at its end.

    If a segment begins inside the chunk, all paths meet there, and the matrix is the product of a
    column of the states that lead to it and the row of the ends that the last such place leads to.
    """
    stop = head + size
    rows = [(START, 0)] if chunk == 0 else states_at(model, part, head)
    breaks = _segment_starts(part, head, stop)
    if breaks:
        first, final = breaks
        ends = _ends(model.reach(part, final, START, stop), stop, len(part))
        lead = [(q, x) for q, x in rows if head + x <= first and first in model.reach(part[:first], head + x, q, first)]
        return [(q, x, *end) for q, x in lead for end in ends]
    out = []
    for q, beyond in rows:
        if beyond >= size:  # the piece covers the whole chunk
            out.append((q, beyond, q, beyond - size))
            continue
        last = model.reach(part, head + beyond, q, stop)
        out += [(q, beyond, *end) for end in _ends(last, stop, len(part), head + beyond)]
    return out


def _ends(last: dict, stop: int, size: int, after: int = -1) -> list[tuple[int, int]]:
    return [(last[e][0], e - stop) for e in range(max(stop, after + 1), size + 1) if e in last]


def trace_chunk(model: Model, head: int, size: int, part: str, enter: tuple[int, int], over: int) -> list[int]:
    """Ids of the pieces that start in the chunk, between the states at its two ends."""
    q, beyond = enter
    start, stop = head + beyond, head + size
    if beyond >= size:
        return []
    breaks = _segment_starts(part, start, stop)
    if not breaks:
        return model.trace(part, model.reach(part, start, q, stop), stop + over)
    first, final = breaks
    ids = model.trace(part[:first], model.reach(part[:first], start, q, first), first)
    ids += memoryview(model.encode_marked([part[first:final]])[0]).cast("i").tolist()
    return ids + model.trace(part, model.reach(part, final, START, stop), stop + over)


def multiply(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """Max-plus product of two matrices given by their entries of weight 0."""
    by_row: dict = {}
    for r, x, c, y in b:
        by_row.setdefault((r, x), []).append((c, y))
    return sorted({(r, x, *end) for r, x, c, y in a for end in by_row.get((c, y), ())})


def cut_states(matrices: list[list[tuple]]) -> list[tuple[int, int]]:
    """The state at every cut, the first included: prefix products, then the path that ends at the text's end."""
    prefix = [matrices[0]]
    for m in matrices[1:]:
        prefix.append(multiply(prefix[-1], m))
    state = next((c, y) for _, _, c, y in prefix[-1] if y == 0)
    states = [state]
    for i in range(len(matrices) - 1, 0, -1):
        reached = {(c, y) for _, _, c, y in prefix[i - 1]}
        state = next((r, x) for r, x, c, y in matrices[i] if (c, y) == state and (r, x) in reached)
        states.append(state)
    return [(START, 0), *reversed(states)]


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in batches:
            for r in batch.to_pylist():
                found = transfer(model, r["chunk"], r["head"], r["size"], r["part"])
                flat = [x for entry in found for x in entry]
                columns = [pa.array([r["row"]], pa.int64()), pa.array([r["chunk"]], pa.int32()), pa.array([flat], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "chunk", "matrix"])

    return run


def _settle(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    states = cut_states([[tuple(r["matrix"][i : i + 4]) for i in range(0, len(r["matrix"]), 4)] for r in rows])
    ends = list(zip(states, states[1:], strict=False))
    return pa.table(
        {
            "row": pa.array([r["row"] for r in rows], pa.int64()),
            "chunk": pa.array([r["chunk"] for r in rows], pa.int32()),
            "enter": pa.array([[*a] for a, _ in ends], pa.list_(pa.int32())),
            "leave": pa.array([[*b] for _, b in ends], pa.list_(pa.int32())),
        }
    )


def _backtrace(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in batches:
            for r in batch.to_pylist():
                ids = trace_chunk(model, r["head"], r["size"], r["part"], r["enter"], r["leave"][1])
                columns = [pa.array([r["row"]], pa.int64()), pa.array([r["chunk"]], pa.int32()), pa.array([ids], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "chunk", "ids"])

    return run


def _encode_giants(giants: DataFrame, path: str, chunk: int) -> DataFrame:
    """row and ids of the texts in (row, text)."""
    longest = Model(path).longest
    chunks = stage_table(giants.mapInArrow(_cut(longest, chunk), _CHUNKS), "giant-chunks").repartition("row", "chunk")
    matrices = chunks.mapInArrow(_matrices(path), "row bigint, chunk int, matrix array<int>")
    states = matrices.groupBy("row").applyInArrow(_settle, "row bigint, chunk int, enter array<int>, leave array<int>")
    traced = chunks.join(states, ["row", "chunk"]).mapInArrow(_backtrace(path), "row bigint, chunk int, ids array<int>")
    parts = traced.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    return parts.select("row", F.flatten("parts.ids").alias("ids"))


# --- operators -------------------------------------------------------------------------------


def encode(df: DataFrame, text_col: str = "text", model: str | None = None, chunk: int = CHUNK, check: bool = False) -> DataFrame:
    """The input with ``ids`` (array<int>) and ``n_tokens``; with ``check`` also ``round_trip``, whether the ids decode to the text."""
    path = model or default_model()
    new = ["ids", "n_tokens"] + ["round_trip"] * check
    kept = [c for c in df.columns if c not in new]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__in"), F.col(text_col).alias("__text"))
    giant = F.length("__text") > chunk
    fields = [packed.schema["__in"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("same", T.BooleanType())]
    plain = packed.filter(~F.coalesce(giant, F.lit(False))).mapInArrow(_encoder(path), T.StructType(fields))
    # Giant texts are written once with a number, so that chunks and rows meet again.
    large = stage_table(packed.filter(giant).withColumn("row", F.monotonically_increasing_id()), "giant-texts")
    found = large.join(_encode_giants(large.select("row", "__text"), path, chunk), "row")
    if check:
        found = decode(found, model=path).withColumn("same", F.col("decoded") == F.replace("__text", F.lit(SPACE), F.lit(" ")))
    else:
        found = found.withColumn("same", F.lit(None).cast("boolean"))
    both = plain.unionByName(found.select("__in", "ids", "same"))
    tokens = F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids"))
    extra = [F.col("same").alias("round_trip")] * check
    return both.select(*[F.col(f"__in.`{c}`").alias(c) for c in kept], "ids", tokens.alias("n_tokens"), *extra)


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in batches:
            for part in (batch.slice(s, 500) for s in range(0, batch.num_rows, 500)):
                texts = [None if x.as_py() is None else model.decode(x.values.to_numpy().tolist()) for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "decoded"]
                )

    return run


def decode(df: DataFrame, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """The input with ``decoded``, the text of the ids; null ids give null."""
    kept = [c for c in df.columns if c != "decoded"]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__in"), F.col(ids_col).alias("__ids"))
    schema = T.StructType([packed.schema["__in"], T.StructField("decoded", T.StringType())])
    out = packed.mapInArrow(_decoder(model or default_model()), schema)
    return out.select(*[F.col(f"__in.`{c}`").alias(c) for c in kept], "decoded")


@query("op7_sentencepiece")
def op7_sentencepiece(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = encode(docs, check=True)
    digest = F.sha2(F.coalesce(F.col("ids").cast("string"), F.lit("")), 256)
    return found.select("doc_id", "n_tokens", digest.alias("ids_sha256"), "round_trip")
