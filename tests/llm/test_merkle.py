"""The Merkle manifest against a plain tree in Python, and positions() against sorting."""

import hashlib
import zlib

from pyspark.sql import functions as F

from lagline.llm.common import positions
from lagline.llm.merkle import audit_documents, document_manifest, merkle_manifest


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(hs, fanout=2):
    out = [hs]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, i, fanout=2):
    out = []
    for level in tree[:-1]:
        b = i // fanout * fanout
        out.append(("".join(level[b:i]), "".join(level[i + 1 : b + fanout])))
        i //= fanout
    return out


def plain(rows, fanout=2):
    """A sorted list of result rows: (doc_id, leaf, subroot, root, proof, folded, verified)."""
    leaf = lambda r, n: digest("".join(map(field, (r[0], r[3], r[2], n, r[1]))))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {g: levels([leaf(r, r[4]) for r in groups[g]], fanout) for g in names}
    top = levels([trees[g][-1][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = siblings(trees[g], i, fanout) + siblings(top, k, fanout)
            now = r[4] + 1 if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else r[4]
            h = leaf(r, now)
            for a, b in path:
                h = digest(a + h + b)
            out.append((r[0], leaf(r, r[4]), trees[g][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return sorted(out, key=repr)


def tampered():
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    return F.col("n_chars") + F.when(hit, 1).otherwise(0)


def odd(rows):
    """Groups of every small size, null and empty groups, repeated ids and rows, null ids and counts."""
    out = [(i, t, ["en", "de", "é", "z"][i % 4] if i % 5 else "en", s, n) for i, t, _, s, n in rows]
    out += [(1000 + i, f"t{i}", f"l{k}", "s", i) for k in range(1, 10) for i in range(k)]
    out += [(7, "x", None, None, None), (None, "y", None, "s", 1), (None, None, "", None, None), (7, "x", None, None, None), (7, "w", None, "s", 2)]
    return out + [(5, "same", "en", "s", 4)] * 3


def test_manifest_equals_plain(spark, rows):
    data = odd(rows)
    docs = spark.createDataFrame([(*r, r[0]) for r in data], "doc_id long, text string, lang string, source string, n_chars long, path long").repartition(5)
    for fanout in (2, 3):
        got = audit_documents(docs, tampered(), fanout)
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain(data, fanout)


def test_small_tables(spark, nothing):
    assert audit_documents(nothing, tampered()).count() == 0
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in ([(7, "a", "en", None, 1)], [(1, "a", "en", "s", 1), (2, "b", "en", "s", 1), (3, "c", "en", "s", 1)], [(1, "", None, "s", None), (1, "", "de", "s", None)]):
        assert sorted(map(tuple, audit_documents(spark.createDataFrame(data, schema), tampered()).collect()), key=repr) == plain(data)


def test_paths_fold_to_the_root(spark, docs):
    held = document_manifest(docs).collect()
    for r in held:
        h = r.leaf
        for step in r.path:
            h = digest(step.before + h + step.after)
        assert h == r.root


def test_a_changed_row_does_not_verify(spark):
    leaves = spark.createDataFrame([(None, i, digest(str(i)), (i,)) for i in range(9)], "g string, place long, h string, item struct<i:long>")
    assert {r.root for r in merkle_manifest(leaves).collect()} == {levels([digest(str(i)) for i in range(9)])[-1][0]}


def test_positions(spark):
    """Gapless places in groups, with one group of most rows and many equal rows."""
    data = [("a" if i % 3 else None, i % 50, "r") for i in range(3000)] + [("b", 1, "r")] + [("c", 4, "same")] * 500
    out = positions(spark.createDataFrame(data, "g string, v int, name string").repartition(7), ["g"], ["v"], "test").collect()
    by = {}
    for r in out:
        by.setdefault(r.g, []).append((r.position, r.v))
    assert len(out) == len(data)
    for g, held in by.items():
        held.sort()
        assert [p for p, _ in held] == list(range(len(held)))
        assert [v for _, v in held] == sorted(v for x, v, _ in data if x == g)
    alone = positions(spark.createDataFrame(data, "g string, v int, name string"), [], ["v", "g"], "test").collect()
    assert sorted(r.position for r in alone) == list(range(len(data)))
