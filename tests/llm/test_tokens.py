import zlib

import numpy as np
import pytest

from cardflux.llm import binary_ids, packing, pieces
from cardflux.llm.encoding import vocabulary

tokenizers = pytest.importorskip("tokenizers")


def library_ids(name, text, end):
    own = tokenizers.Tokenizer.from_file(vocabulary(name))
    return np.array([*own.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing_covers_every_id_once_without_padding(table_of, odd_pairs):
    rows = packing.pack(table_of(odd_pairs)).collect()
    texts = sorted(library_ids("byte_bpe_50k.json", text, 0).tobytes() for _, text in odd_pairs)
    assert sum(row["length"] for row in rows) == sum(len(t) // 4 for t in texts)
    by_id = {}
    for doc_id, text in odd_pairs:
        by_id.setdefault(doc_id, library_ids("byte_bpe_50k.json", text, 0))
    for row in rows:
        if row["doc_id"] != 9:
            ids = by_id[row["doc_id"]]
            assert row["doc_tokens"] == len(ids)
            assert row["ids_crc32"] == zlib.crc32(ids[row["start"] : row["start"] + row["length"]].tobytes())
    sequences = {}
    for row in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert row["offset"] == sequences.get(row["sequence_id"], 0)
        sequences[row["sequence_id"]] = row["offset"] + row["length"]
    assert all(size <= 1024 and size & (size - 1) == 0 for size in sequences.values())


def test_hilbert_neighbours_are_one_step_apart():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    path = grid[np.argsort(packing.hilbert_keys(grid, 4))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_orc_files_hold_the_library_ids_in_order(shipped, table_of, odd_pairs, tmp_path):
    folder = str(tmp_path / "ids")
    binary_ids.write_token_ids(table_of(odd_pairs), folder, "word_bpe_49k.json", 2)
    rows = sorted(binary_ids.read_token_ids(shipped, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in odd_pairs), key=lambda i: (i is not None, i))
    at = 0
    texts = dict(odd_pairs)
    for row in rows:
        assert row["start"] == at
        assert row["ids"] == library_ids("word_bpe_49k.json", texts[row["doc_id"]], 2).tolist()
        at += row["n_tokens"]
    assert [r["doc_id"] for r in binary_ids.lookup(shipped, folder, [5]).collect()] == [5]
    digests = binary_ids.checksums(binary_ids.read_token_ids(shipped, folder)).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in digests}[5] == zlib.crc32(library_ids("word_bpe_49k.json", texts[5], 2).tobytes())


def varint(raw, at):
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 128:
            return value, at


def fields(raw):
    at = 0
    while at < len(raw):
        begin = at
        tag, at = varint(raw, at)
        value = b""
        if tag & 7 == 0:
            value, at = varint(raw, at)
        elif tag & 7 == 2:
            size, at = varint(raw, at)
            value, at = raw[at : at + size], at + size
        else:
            at += {5: 4, 1: 8}[tag & 7]
        yield tag >> 3, value, raw[begin:at]


def as_unigram(raw):
    """The model file with its kind set to Unigram, so that the library searches for the best sum of scores."""
    out = b""
    for number, value, whole in fields(raw):
        if number == 2:
            spec = b"".join(part for n, _, part in fields(value) if n != 3) + bytes([3 << 3, 1])
            size, coded = len(spec), b""
            while size >= 128:
                coded, size = coded + bytes([size & 127 | 128]), size >> 7
            whole = bytes([2 << 3 | 2]) + coded + bytes([size]) + spec
        out += whole
    return out


def test_viterbi_gives_the_library_segmentation_and_restores_texts(table_of, odd_pairs):
    sentencepiece = pytest.importorskip("sentencepiece")
    with open(vocabulary("piece_bpe_32k.model"), "rb") as file:
        library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(file.read()))
    own = pieces.PieceEncoder(vocabulary("piece_bpe_32k.model"))
    chunks = [" " + w for w in "the quick brown fox jumps over lazy dogs unbelievably internationalization Häuser été".split()]
    scores = {library.id_to_piece(i): library.get_score(i) for i in range(259, library.get_piece_size())}
    same = 0
    for chunk, ids in zip(chunks, own.segmented(chunks)):
        marked, best = chunk.replace(" ", "▁"), [0.0]
        for end in range(1, len(marked) + 1):
            best.append(max(best[i] + scores[marked[i:end]] for i in range(end) if marked[i:end] in scores))
        assert sum(library.get_score(i) for i in ids.tolist()) == best[-1]
        same += ids.tolist() == library.encode(chunk.strip())
    assert same >= len(chunks) - 1  # the library keeps the one piece of " the", whose score is less than that of two
    encoded = pieces.encode(table_of(odd_pairs))
    decoded = pieces.decode(encoded)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in decoded.collect()) == sorted((i or 0, t or "") for i, t in odd_pairs)
    assert all(r["restored"] for r in pieces.digests(decoded).collect())


def test_empty_tables(shipped, table_of, tmp_path):
    empty = table_of([(1, "x")]).limit(0)
    assert packing.pack(empty).count() == 0
    assert pieces.digests(pieces.decode(pieces.encode(empty))).count() == 0
    binary_ids.write_token_ids(empty, str(tmp_path / "e"), "word_bpe_49k.json", 2)
    assert binary_ids.read_token_ids(shipped, str(tmp_path / "e")).count() == 0
