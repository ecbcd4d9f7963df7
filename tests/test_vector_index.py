import numpy as np
import pyarrow as pa
import pytest

from tests.helpers import pairs
from tidemark.functions import similarity
from tidemark.operators import retrieval, vector_index

SMALL = vector_index.Projections(8, bits=128, tables=3, width=4)


def vectors(spark, m, name, k=None, parts=3):
    rows = [(i, None if v is None else [float(x) for x in v], *([k] if k else [])) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, f"{name} long, vector array<double>" + (", k int" if k else "")).repartition(parts)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    m = list(rng.standard_normal((120, 8)))
    m[40:80] = [m[0]] * 40  # a third are copies
    return [*m, np.zeros(8), None]


@pytest.mark.parametrize("block", [4096, 10])
def test_all_probes_and_all_rescored_are_exact(spark, points, block):
    index = vector_index.build(vectors(spark, points, "chunk_id"), SMALL)
    asked = vectors(spark, points[:50] + [None], "query_id", 4)
    found = vector_index.candidates(index, asked, probes=16, rescored=1000, exclude_self=True, block=block)
    got = sorted(pairs(vector_index.scored(index, asked, found), "query_id", "chunk_id", "score", "rank"))
    want = sorted(pairs(similarity.topk(asked, vectors(spark, points, "chunk_id"), exclude_self=True), "query_id", "chunk_id", "score", "rank"))
    assert got == want


def test_scan_and_cells_give_the_same_candidates(spark, points):
    index = vector_index.build(vectors(spark, points, "chunk_id"), SMALL)
    asked = vectors(spark, points, "query_id", 4)
    of = lambda **o: sorted(pairs(vector_index.candidates(index, asked, probes=3, rescored=6, **o), "query_id", "k", "chunk_id", "distance"))
    assert of(block=4096) == of(block=7) != []


def plain(points, p, probes):
    known = [i for i, v in enumerate(points) if v is not None]
    signatures, margins = p.project([points[i] for i in known])
    bits = np.unpackbits(signatures.view(np.uint8), axis=1)
    out = set()
    for a in range(len(known)):
        for b in range(len(known)):
            for t in range(p.tables):
                flips = np.nonzero((margins[a, t] > 0) != (margins[b, t] > 0))[0]
                cost = sum(margins[a, t, f] ** 2 for f in flips)
                cheaper = sum(sum(margins[a, t, f] ** 2 for f in range(p.width) if s >> f & 1) < cost - 1e-12 for s in range(1 << p.width))
                if cheaper < probes:
                    out.add((known[a], known[b], int((bits[a] != bits[b]).sum())))
    return out


def test_pairs_meet_where_the_cheapest_flips_lead(spark, points):
    some = [v for v in points[:40] if v is not None]
    index = vector_index.build(vectors(spark, some, "chunk_id"), SMALL)
    found = vector_index.candidates(index, vectors(spark, some, "query_id", 1), probes=3, rescored=1000)
    assert set(pairs(found, "query_id", "chunk_id", "distance")) == plain(some, SMALL, 3)


def test_signatures_measure_angles():
    p = vector_index.Projections(64)
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((300, 64)), rng.standard_normal((300, 64))
    b = a * np.linspace(0, 1, 300)[:, None] + b * np.linspace(1, 0, 300)[:, None]
    angle = np.arccos(np.clip((a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1), -1, 1))
    got = vector_index.distances(p.project(list(a))[0], p.project(list(b))[0]) / p.bits * np.pi
    assert np.abs(got - angle).max() < 0.2 and np.abs(got - angle).mean() < 0.04


def test_index_is_written_once_and_read(spark, points, tmp_path):
    index = vector_index.build(vectors(spark, points, "chunk_id"), SMALL)
    index.write(str(tmp_path / "index"))
    again = vector_index.read(spark, str(tmp_path / "index"), vector_index.Projections(8, bits=128, tables=3, width=4))
    asked = vectors(spark, points[:9], "query_id", 3)
    assert pairs(vector_index.search(index, asked, 4, 9).orderBy("query_id", "rank"), "query_id", "chunk_id") == pairs(
        vector_index.search(again, asked, 4, 9).orderBy("query_id", "rank"), "query_id", "chunk_id")


def test_empty_sides(spark):
    none, one = vectors(spark, [None], "chunk_id"), vectors(spark, [[1.0, 0.0]], "query_id", 2)
    assert retrieval.dense_topk_approx(one, none).count() == 0
    assert retrieval.dense_topk_approx(one.limit(0), vectors(spark, [[1.0, 0.0]], "chunk_id")).count() == 0
    with pytest.raises(ValueError):
        vector_index.Projections(8, bits=100)


def test_questions_go_to_cells_once_whatever_they_probe(spark, points, monkeypatch):
    """Before, a question was repeated for each code that it probes, and each number of probes compared all pairs again."""
    index = vector_index.build(vectors(spark, points, "chunk_id"), SMALL)
    asked, sent, grid = vectors(spark, points, "query_id", 4), [], similarity.grid
    monkeypatch.setattr(similarity, "grid", lambda left, *rest: sent.append(left.count()) or grid(left, *rest))
    wide = dict(rescored=6, exclude_self=True, block=30)
    found = vector_index.candidates_at(index, asked, (1, 3, 16), **wide)
    columns = ("query_id", "k", "chunk_id", "distance")
    got = {p: sorted(pairs(found.where(f"probes = {p}"), *columns)) for p in (1, 3, 16)}
    assert sent == [121]
    assert got == {p: sorted(pairs(vector_index.candidates(index, asked, p, 6, exclude_self=True), *columns)) for p in (1, 3, 16)}
    best = vector_index.scored(index, asked, found)
    assert sorted(pairs(best.where("probes = 3"), "query_id", "chunk_id", "rank")) == sorted(
        pairs(vector_index.search(index, asked, 3, 6, exclude_self=True), "query_id", "chunk_id", "rank"))


def lists(m):
    m = np.asarray(m)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def fed(work, table, piece):
    for at in range(0, len(table), piece):
        work.add(table.slice(at, piece).combine_chunks())
    return work.table()


def test_cells_send_out_only_the_best_of_a_question(spark, points, monkeypatch):
    """Before, each of the blocks of chunks sent out the best of every question, 13 times the rows that stay."""
    sent, grid = [], similarity.grid
    monkeypatch.setattr(similarity, "grid", lambda *a: sent.append(grid(*a)) or sent[-1])
    index = vector_index.build(vectors(spark, points, "chunk_id"), SMALL)
    kept = vector_index.candidates_at(index, vectors(spark, points, "query_id", 4), (1, 16), 6, True, 10)
    assert sent[0].count() == kept.count() > 6 * 121
    best = similarity.topk(vectors(spark, points, "query_id", 4), vectors(spark, points, "chunk_id"), block=10)
    assert sent[1].count() == best.count() == 4 * 121


@pytest.mark.parametrize("bits", [128, 1024, 2048])
def test_products_of_packed_signs_are_the_distances(bits):
    p, rng = vector_index.Projections(16, bits=bits, tables=2, width=3), np.random.default_rng(4)
    a, b = rng.standard_normal((7, 16)), rng.standard_normal((10, 16))
    a[1], b[0], b[1] = a[0], a[0], -a[0]
    x, y = p.project(a)[0], p.project(b)[0]
    space = [np.empty(40, np.float32), np.empty(160, np.float32)]
    got = vector_index._Tile(p, a, 2).products(vector_index._signs(y.view(np.uint8)), space)
    assert ((bits - got) // 2).tolist() == [vector_index.distances(np.repeat(x[i : i + 1], 10, 0), y).tolist() for i in range(7)]
    assert got[0, 0] == bits and got[0, 1] == -bits


@pytest.mark.parametrize("piece", [8, 50, 1000])
def test_streams_equal_brute_force(piece):
    """Copies, ids that come twice, a zero vector, k of 0 and null; the first pieces are worked on as a whole, later ones where they are near."""
    rng = np.random.default_rng(11)
    m = rng.standard_normal((600, 8)).astype(np.float32)
    m[100:250], m[300] = m[0], 0
    ids = np.sort(np.r_[np.arange(590), rng.integers(0, 590, 10)])
    ks = [None if i == 5 else i % 5 for i in range(600)]
    asked = pa.table({"query_id": np.arange(600), "vector": lists(m), "k": pa.array(ks, pa.int32())})
    got = fed(similarity.Best(asked, True), pa.table({"chunk_id": ids, "vector": lists(m)}), piece).to_pandas()
    u = m / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-9)
    scores = np.round(u @ u.T, 6)
    want = [sorted((-scores[q, c], ids[c]) for c in range(600) if ids[c] != q)[: ks[q] or 0] for q in range(600)]
    assert [(q, c) for q, c in zip(got["query_id"], got["chunk_id"])] == [(q, c) for q in range(600) for _, c in want[q]]
    assert got["score"].tolist() == pytest.approx([-s for row in want for s, _ in row])

    words, margins = SMALL.project(m)
    rows = pa.table({"chunk_id": ids, "signature": pa.array([w.tobytes() for w in words], pa.binary()), "codes": lists(SMALL.codes(margins).astype(np.int32))})
    got = fed(vector_index._Cell(SMALL, (1, 4, 16), 6, True, asked), rows, piece).to_pandas()
    bits = np.unpackbits(words.view(np.uint8), axis=1).astype(int)
    far, probed, codes = np.abs(bits[:, None] - bits[None]).sum(2), SMALL.probes(margins, 16), SMALL.codes(margins)
    for n in (1, 4, 16):
        met = np.any([(probed[:, t, None, :n] == codes[None, :, t, None]).any(2) for t in range(SMALL.tables)], axis=0)
        want = []
        for q in range(600):
            near = {}
            for c in np.flatnonzero(met[q] & (ids != q)):
                near[ids[c]] = min(near.get(ids[c], 999), far[q, c])
            want += [(q, c, d) for d, c in sorted((d, c) for c, d in near.items())[:6]]
        of = got[got["probes"] == n]
        assert list(zip(of["query_id"], of["chunk_id"], of["distance"])) == want
