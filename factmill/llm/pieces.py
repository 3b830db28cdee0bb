"""Encoding and decoding with a SentencePiece model, by a table of distinct chunks.

The model writes a blank as a whitespace marker and begins every text with
one.  Where no piece of its vocabulary goes on from another character to a
marker, no merge does either: a text falls into chunks, markers and the word
behind them, that are segmented independently.  So each distinct chunk is
segmented once, by the library, and a text's ids are its chunks' ids in the
order of their positions.

Each task keeps one such table for all texts it sees, up to a bound, beyond
which it begins anew; what is in it doesn't change results.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .shared import SLICE_BYTES, number_words, places, text_slices

MARKER = "▁"
_MARKER_BYTES = MARKER.encode()
#: Bytes of chunks and ids that a task's table holds, at most.
TABLE_BYTES = 32 << 20
#: What a chunk costs besides its bytes and ids.
_ENTRY = 150


class Encoder:
    """A model and the table of the chunks that it has segmented."""

    def __init__(self, model: bytes, begin: bool = True, end: bool = True):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.begin = [self.sp.bos_id()] if begin else []
        self.end = [self.sp.eos_id()] if end else []
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        # cut at markers only if the vocabulary allows it, and if the model takes blanks as they are
        self.apart = not any(MARKER in name.lstrip(MARKER) for name in names) and self.sp.encode("a  b", out_type=str)[0].startswith(MARKER) and self.sp.decode(self.sp.encode(" a  b ")) == " a  b "
        # a lone marker within a text: the library has no text that is it alone
        self.lone = np.array(self.sp.encode("a ")[len(self.sp.encode("a")) :], np.int32).tobytes()
        self.table: dict[bytes, bytes] = {}
        self.held = 0
        self._decoder(names)

    def _decoder(self, names: list[str]) -> None:
        """What each id stands for in a text, as bytes; and which id it is that begins with a marker."""
        shown = []
        for i, name in enumerate(names):
            shown.append(b"" if self.sp.is_control(i) else bytes([int(name[3:5], 16)]) if self.sp.is_byte(i) else name.replace(MARKER, " ").encode())
        self.plain = np.array([not self.sp.is_unknown(i) and not self.sp.is_unused(i) for i in range(len(names))])
        self.sizes = np.array([len(s) for s in shown], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.blank = np.array([s[:1] == b" " and not self.sp.is_byte(i) for i, s in enumerate(shown)])

    def ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks without their first marker, from the table; those it lacks are segmented first."""
        own = [self.table.get(c) for c in chunks]
        missing = [i for i, ids in enumerate(own) if ids is None]
        for i, ids in zip(missing, self.sp.encode([chunks[i].decode() for i in missing], num_threads=1), strict=True):
            own[i] = array("i", ids).tobytes() if chunks[i] else self.lone
            self.table[chunks[i]] = own[i]
            self.held += len(chunks[i]) + len(own[i]) + _ENTRY
        if self.held > TABLE_BYTES:
            self.table, self.held = {}, 0
        return own

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, one after the other, and how many each has."""
        if not self.apart:
            texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ids = [np.array([*self.begin, *x, *self.end], np.int32) for x in self.sp.encode(texts, num_threads=1)]
            return np.concatenate(ids), np.array([len(x) for x in ids])
        found, counts = [], np.zeros(len(offsets) - 1, np.int64)
        for starts, ends, rows, part in self._chunks(data, offsets):
            numbers, first = number_words(part, starts, ends)
            ids = self.ids_of([part[starts[i] : ends[i]].tobytes() for i in first.tolist()])
            sizes = np.array([len(x) >> 2 for x in ids], np.int64)
            flat, at = np.frombuffer(b"".join(ids), np.int32), np.cumsum(sizes) - sizes
            found.append(flat[places(at[numbers], sizes[numbers])])
            np.add.at(counts, rows, sizes[numbers])
        ids = np.concatenate(found) if found else np.zeros(0, np.int32)
        # begin and end ids around each text
        before, after = len(self.begin), len(self.end)
        out = np.empty(len(ids) + (before + after) * len(counts), np.int32)
        ends = np.cumsum(counts + before + after)
        edge = ends - counts - before - after
        for k, i in enumerate(self.begin):
            out[edge + k] = i
        for k, i in enumerate(self.end):
            out[ends - after + k] = i
        out[places(edge + before, counts)] = ids
        return out, counts + before + after

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Starts and ends of chunks without their first marker, their rows and the bytes they lie in; a long text in stretches."""
        at = 0
        while at < len(data):
            end = min(at + SLICE_BYTES, len(data))
            while True:
                part, marks, sizes = data[at:end], *self._marks(data[at:end])
                inside = np.zeros(len(part), dtype=bool)
                inside[marks] = True
                inside[marks[sizes == 3] + 1] = inside[marks[sizes == 3] + 2] = True
                edges = offsets[(offsets >= at) & (offsets < end)] - at
                # a marker begins a chunk unless another one, or the text's own, stands before it
                new = marks[(marks > 0) & ~inside[marks - 1]]
                begins = np.zeros(len(part), dtype=bool)
                begins[0] = begins[new] = begins[edges] = True
                begins = np.flatnonzero(begins)
                if end == len(data) or len(begins) > 1:
                    break
                end = min(2 * end - at, len(data))  # one chunk fills the stretch
            if end < len(data):
                # what begins last may go on, and a marker may be cut at the end: both are left to the next stretch
                part, begins = part[: begins[-1]], begins[:-1]
                end = at + len(part)
            starts, stops = begins.copy(), np.append(begins[1:], len(part))
            # rows begin with the library's own marker, other chunks with one of their own
            first = np.zeros(len(begins), dtype=bool)
            first[np.searchsorted(begins, edges[edges < len(part)])] = True
            size = np.ones(len(part) + 1, np.int64)
            size[marks[marks < len(part)]] = sizes[marks < len(part)]
            starts[~first] += size[begins[~first]]
            rows = np.searchsorted(offsets, begins + at, side="right") - 1
            yield starts, stops, rows, part
            at = end

    @staticmethod
    def _marks(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of markers and blanks, and their bytes."""
        long = part == _MARKER_BYTES[0]
        long[:-1] &= part[1:] == _MARKER_BYTES[1]
        long[:-2] &= part[2:] == _MARKER_BYTES[2]
        long[-2:] = False
        marks = np.flatnonzero(long | (part == 0x20))
        return marks, np.where(part[marks] == 0x20, 1, 3)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of lists of ids: their pieces joined, the first marker left out.

        Lists with unknown ids, or whose bytes are no valid text, go through
        the library itself.
        """
        out, rows = [], len(offsets) - 1
        odd = ids >= len(self.sizes)
        odd |= ids < 0
        odd[~odd] = ~self.plain[ids[~odd]]
        for r in range(rows):
            own = ids[offsets[r] : offsets[r + 1]]
            text = None
            if not odd[offsets[r] : offsets[r + 1]].any():
                own_sizes = self.sizes[own]
                data = b"".join(self.shown[places(self.starts[own[a : a + SLICE_BYTES]], own_sizes[a : a + SLICE_BYTES])].tobytes() for a in range(0, len(own), SLICE_BYTES))
                shown = np.flatnonzero(own_sizes[:64] > 0)
                if len(shown) or len(own) <= 64:
                    if len(shown) and self.blank[own[shown[0]]]:
                        data = data[1:]
                    try:
                        text = data.decode()
                    except UnicodeDecodeError:
                        pass
            out.append(self.sp.decode(own.tolist()) if text is None else text)
        return pa.array(out, pa.string())


_encoders: dict[tuple, Encoder] = {}


def _encoder(model: bytes, begin: bool, end: bool) -> Encoder:
    """The worker's encoder, with its table."""
    key = (model, begin, end)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model, begin, end)
    return _encoders[key]


def _model(path: str) -> bytes:
    """A model's file, read on the driver: executors get its bytes."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """``doc_id, ids``: every whole text's ids as the library gives them, without sampling.

    A null text is an empty one: begin and end ids alone.  Null ids of
    documents stay null; repeated rows are encoded each; an empty table gives
    no rows; other columns are ignored.  A model whose pieces cross markers
    has whole texts as chunks.
    """
    held = docs.sparkSession.sparkContext.broadcast(_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value, begin, end)
        for part in text_slices(batches):
            ids, counts = encoder.encode(part.data, part.offsets)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("_id").cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=["doc_id", "ids"])

    return docs.select(docs[id_column].alias("_id"), docs[text_column].alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model_path: str, ids_column: str = "ids", then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str | None = None) -> DataFrame:
    """``encoded`` with a ``text`` behind its columns: what the library decodes from the ids; null ids give a null text.

    ``then`` makes other rows, of ``schema``, of each batch in the same worker:
    neither ids nor texts travel further than they have to.
    """
    held = encoded.sparkSession.sparkContext.broadcast(_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value, True, True)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                column = part.column(part.schema.get_field_index(ids_column))
                offsets = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
                texts = encoder.decode(column.flatten().to_numpy(zero_copy_only=False), offsets)
                if column.null_count:
                    texts = pa.array([None if n else t for n, t in zip(column.is_null().to_pylist(), texts.to_pylist(), strict=True)], pa.string())
                made = pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "text"])
                yield then(made) if then else made

    return encoded.mapInArrow(run, schema or f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema)}, text string")
