import numpy as np
import pytest

from tracewright.llm.bucket_join import BLOCK, Contents, Joined, index_pairs, joining_links
from tracewright.llm.store import Store


@pytest.mark.parametrize("prefix", ["", "file://"])
def test_arrays_come_back(tmp_path, prefix):
    store = Store(f"{prefix}{tmp_path}/deep")
    store.save("1/a", np.arange(5, dtype=np.uint64))
    store.save("1/a", np.arange(6, dtype=np.uint64))
    store.save("1/none", np.zeros(0, np.uint64))
    assert store.load("1/a", np.uint64).tolist() == [0, 1, 2, 3, 4, 5] and len(store.load("1/none", np.uint64)) == 0
    with pytest.raises(FileNotFoundError):
        store.load("2/a", np.uint64)


def test_contents_rule_out_pairs(spark, tmp_path):
    rows = [(i, 100, (1 << i).to_bytes(8, "little"), b"x" * i) for i in range(40)] + [(-5, 3, bytes(8), b"")]
    store = Contents(str(tmp_path), 3, 1)
    store.write(spark.createDataFrame(rows, "item long, n long, bits binary, content binary"))
    known, n, bits = store.of(np.array([39, -5, 77]))
    assert known.tolist() == [True, True, False] and n.tolist()[:2] == [100, 3] and bits[0, 0] == 1 << 39
    near = store.near(np.array([1, 1, 1]), np.array([1, 2, 77]), lambda a, b, off: off == 0)
    assert near.tolist() == [True, False, True]
    assert [None if c is None else len(c) for c in store.content(np.array([7, -5, 77, 0, 39]))] == [7, 0, None, 0, 39]


def test_blocks_of_a_large_bucket(spark, tmp_path):
    """Members beyond one block meet in pairs of blocks; links come out once for each two sets that they join."""
    m = 2 * BLOCK + 300
    rows = [(i, 1, bytes(8), int(i % 50).to_bytes(8, "little")) for i in range(m)]
    store = Contents(str(tmp_path), 3, 1)
    store.write(spark.createDataFrame(rows, "item long, n long, bits binary, content binary"))
    members = spark.createDataFrame([(9, m, i, i) for i in range(m)] + [(4, 3, i, 7) for i in range(3)], "bucket long, m long, item long, component long")

    def similar(contents, i, j):
        value = np.array([c.view(np.int64)[0] for c in contents])
        return value[i] == value[j]

    links = joining_links(members, store, lambda a, b, off: off == 0, similar).collect()
    assert len(links) < 6 * m and all(r.a % 50 == r.b % 50 for r in links)
    joined = Joined()
    for r in links:
        joined.join(r.a, r.b)
    assert len({joined.find(i) for i in range(m)}) == 50


def test_index_pairs():
    for m in (0, 1, 2, 5, 64, 65, 700):
        pairs = [p for i, j in index_pairs(m) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(pairs) == len(set(pairs)) == m * (m - 1) // 2 and all(0 <= i < j < m for i, j in pairs)
