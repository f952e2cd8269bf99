"""SentencePiece encoding and decoding with a batched Viterbi search in numpy.

A text gets a space in front and is cut before each run of spaces, where no piece of the vocabulary can
cross. Distinct chunks of a worker are segmented once. Those of equal length advance together, one code
point per step: the hashes of all substrings that end there probe the sorted keys of the pieces, and the
running maxima of the summed scores store the length and the piece they came from.

The result is the segmentation with the greatest sum of the model file's piece scores, as the library
gives for models of the Unigram kind; for files trained with merges, whose scores are ranks, it is the best
segmentation under those scores, not the order of merges. A code point without a piece falls back to its
UTF-8 bytes. Decoding joins the pieces and drops the space in front; it restores every text, except that
U+2581, the vocabulary's own mark for a space, comes back as a space.

Defined cases: NULL and empty texts have no ids and decode to an empty text; of equal sums the longer last piece wins; repeated rows,
repeated or NULL ``doc_id`` are encoded like any other; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cardflux.llm.encoding import Encoder, vocabulary
from cardflux.llm.store import require
from cardflux.llm.textbytes import BASE, mix, stream, text_slices

MARK = "▁"
#: Words of one length that advance together, which bounds the arrays.
TOGETHER = 20_000
ENCODED = "doc_id long, ids array<int>, text_crc32 long, n_bytes long"
DECODED = "doc_id long, ids array<int>, text string, text_crc32 long, n_bytes long"


class PieceTable:
    """Pieces of a model file: scores, hashed keys in order, and bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        special = np.array([model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)])
        scores = np.array([model.get_score(i) for i in range(size)], np.float64)
        self.byte_ids = np.zeros(256, np.uint16)
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        plain = np.flatnonzero(~special)
        self.longest = max(len(pieces[i]) for i in plain)
        keys = np.array([key_of(pieces[i]) for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], plain[order]
        self.scores = scores[self.ids]
        usual = self.scores[self.scores > -1e6]
        self.unknown = (usual.min() if len(usual) else 0.0) - 10.0
        raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in raw])
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)


def code_values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(0x1F123BB5))


LENGTH_KEYS = stream(41, 64)


def key_of(piece: str) -> int:
    """Hash of a whole piece, equal to that of the same substring in :func:`segment`."""
    total = 0
    for value in code_values(np.array([ord(c) for c in piece])).tolist():
        total = (total * BASE + value) & (1 << 64) - 1
    return int(mix(np.array([total], np.uint64) ^ LENGTH_KEYS[len(piece) % 64])[0])


def segment(codes: np.ndarray, table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """Backpointers of words of one length (one row of code points each): last piece's place and length per position."""
    n, length = codes.shape
    sums = np.zeros((length + 1, n), np.uint64)
    values = code_values(codes)
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    piece = np.full((length + 1, n), -1, np.int32)
    back = np.ones((length + 1, n), np.uint8)
    power = [1]
    with np.errstate(over="ignore"):
        for end in range(1, length + 1):
            sums[end] = sums[end - 1] * np.uint64(BASE) + values[:, end - 1]
            best[end] = best[end - 1] + table.unknown
            for size in range(1, min(table.longest, end) + 1):
                if len(power) <= size:
                    power.append(power[-1] * BASE & (1 << 64) - 1)
                keys = mix(sums[end] - sums[end - size] * np.uint64(power[size]) ^ LENGTH_KEYS[size % 64])
                at = np.minimum(np.searchsorted(table.keys, keys), len(table.keys) - 1)
                known = table.keys[at] == keys
                total = np.where(known, best[end - size] + table.scores[at], -np.inf)
                if size == 1:
                    best[end][known] = -np.inf  # only a code point without a piece is unknown
                better = total >= best[end]
                best[end][better] = total[better]
                piece[end][better] = at[better]
                back[end][better] = size
    return piece, back


def walk_back(codes: np.ndarray, piece: np.ndarray, back: np.ndarray, table: PieceTable) -> list[np.ndarray]:
    """Ids of each word, from the backpointers."""
    length, n = len(piece) - 1, codes.shape[0]
    position = np.full(n, length)
    steps = []
    while position.any():
        rows = np.flatnonzero(position)
        at = position[rows]
        steps.append((rows, piece[at, rows], at))
        position[rows] = at - back[at, rows]
    if not steps:
        return [np.zeros(0, np.uint16)] * n
    rows, found, ends = (np.concatenate([s[i] for s in reversed(steps)]) for i in range(3))
    order = np.argsort(rows, kind="stable")
    rows, found, ends = rows[order], found[order], ends[order]
    ids = table.ids[np.maximum(found, 0)].astype(np.uint16)
    bounds = np.searchsorted(rows, np.arange(n + 1))
    out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    for row in np.unique(rows[found < 0]).tolist():
        a, b = bounds[row], bounds[row + 1]
        parts = [
            ids[k : k + 1] if found[k] >= 0 else table.byte_ids[list(chr(codes[row, ends[k] - 1]).encode())]
            for k in range(a, b)
        ]
        out[row] = np.concatenate(parts)
    return out


class PieceEncoder(Encoder):
    """The worker's memory of chunks, filled by the batched search."""

    def __init__(self, path: str):
        self.table = PieceTable(path)
        self.byte_level = False
        self.forget()

    def units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        space = data == 0x20
        cut = first[:-1].copy()
        cut[1:] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(data))

    def segmented(self, texts: list[str]) -> list[np.ndarray]:
        marked = [text.replace(" ", MARK) for text in texts]
        sizes = np.array([len(text) for text in marked])
        out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(texts)
        for size in np.unique(sizes).tolist():
            same = np.flatnonzero(sizes == size)
            together = max(1, min(TOGETHER, 4_000_000 // size))
            for begin in range(0, len(same), together):
                part = same[begin : begin + together].tolist()
                codes = np.frombuffer("".join(marked[i] for i in part).encode("utf-32-le"), np.uint32).reshape(len(part), size)
                for i, ids in zip(part, walk_back(codes, *segment(codes, self.table), self.table)):
                    out[i] = ids
        return out

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = self.segmented(texts)
        lengths = np.array([len(row) for row in rows])
        return lengths, np.concatenate(rows)

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts of ids in a row, and where each begins; the space in front of each is left out."""
        lengths = self.table.lengths[ids]
        total = np.concatenate([[0], np.cumsum(lengths)])
        data = self.table.bytes[np.repeat(self.table.places[ids] - total[:-1], lengths) + np.arange(total[-1])]
        starts = total[begin]
        front = starts[:-1][starts[:-1] < starts[1:]]
        front = front[data[front] == 0x20]
        keep = np.ones(len(data), bool)
        keep[front] = False
        return data[keep], starts - np.searchsorted(front, starts)


_made: dict[str, PieceEncoder] = {}


def piece_encoder(model: str) -> PieceEncoder:
    """The worker's encoder for this model file."""
    if model not in _made:
        _made[model] = PieceEncoder(model)
    return _made[model]


def _prepared(texts: pa.Array) -> pa.Array:
    """Texts with a space in front, except empty ones."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
    return pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """``doc_id, ids`` of every whole text, with the CRC-32 and the size of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_encoder(vocabulary(model))
        for rows, data, bounds in text_slices(batches):
            raw = memoryview(data).cast("B") if len(data) else memoryview(b"")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            ready = pa.RecordBatch.from_arrays([_prepared(rows.column("text"))], names=["text"])
            for _, marked, marks in text_slices(iter([ready]), limit=1 << 62):
                ids, begin = own.encode(marked, marks)
            lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids.astype(np.int32)))
            columns = [rows.column("doc_id").cast(pa.int64()), lists, pa.array(crc, pa.int64()), pa.array(np.diff(bounds))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text_crc32", "n_bytes"])

    return require(docs, ["doc_id", "text"]).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """``encoded`` with the ``text`` of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_encoder(vocabulary(model))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                lists = rows.column("ids")
                begin = lists.offsets.to_numpy().astype(np.int64)
                ids = lists.values.to_numpy(zero_copy_only=False)[begin[0] : begin[-1]]
                data, bounds = own.decode(ids, begin - begin[0])
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                columns = [rows.column("doc_id"), lists, pa.array(texts, pa.string()), rows.column("text_crc32"), rows.column("n_bytes")]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text", "text_crc32", "n_bytes"])

    return encoded.select("doc_id", "ids", "text_crc32", "n_bytes").mapInArrow(run, DECODED)


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, n_bytes, text_crc32, restored``: whether the decoded text is the encoded one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            begin = lists.offsets.to_numpy().tolist()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin[:-1], begin[1:])]
            texts = [t.as_buffer() or b"" for t in batch.column("text").cast(pa.binary())]
            same = [zlib.crc32(t) == c and len(memoryview(t)) == n for t, c, n in zip(texts, batch.column("text_crc32").to_pylist(), batch.column("n_bytes").to_pylist())]
            columns = [batch.column("doc_id"), pa.array(np.diff(begin), pa.int64()), pa.array(crc, pa.int64()), batch.column("n_bytes"), batch.column("text_crc32"), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_crc32", "n_bytes", "text_crc32", "restored"])

    return decoded.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, n_bytes long, text_crc32 long, restored boolean")
