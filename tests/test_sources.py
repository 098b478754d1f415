import struct

import numpy as np
import pytest

from heritas import errors as e
from heritas.sources import binary, plink, tables


def trio(tmp_path, g, chroms=None):
    n, p = g.shape[1], g.shape[0]
    prefix = str(tmp_path / "x.v1")
    plink.write_plink(prefix, g, [(f"fam{i % 5 + 1}", f"s{i}") for i in range(n)], [(chroms[j] if chroms else "1", f"rs{j}", j + 1, "AC", "T") for j in range(p)])
    return prefix


def test_bed_scan(spark, tmp_path):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, (37, 10)).astype(float)
    g[rng.random(g.shape) < 0.1] = np.nan
    prefix = trio(tmp_path, g)
    rows = plink.read_bed(spark, prefix, partitionLoci=8).orderBy("snp_idx").collect()
    got = np.array([[np.nan if v is None else v for v in r["dosage"]] for r in rows])
    assert np.array_equal(got, g, equal_nan=True)
    part = plink.read_bed(spark, prefix, start=5, end=9, keep="3,-1,0").orderBy("snp_idx").collect()
    assert [r["snp_idx"] for r in part] == [5, 6, 7, 8]
    assert all(r["dosage"][1] is None and r["dosage"][0] == (None if np.isnan(g[r["snp_idx"], 3]) else g[r["snp_idx"], 3]) for r in part)
    bim = plink.read_bim(spark, prefix + ".bim").orderBy("snp_idx").collect()
    assert (bim[4]["snp_id"], bim[4]["pos"], bim[4]["a1"], bim[4]["a2"], len(bim)) == ("rs4", 5, "A", "T", 37)
    fam = plink.read_fam(spark, prefix + ".fam").orderBy("raw_idx").collect()
    assert (fam[6]["fid"], fam[6]["iid"], len(fam)) == ("fam2", "s6", 10)


def test_bed_errors(spark, tmp_path):
    prefix = trio(tmp_path, np.ones((4, 5)))
    with pytest.raises(e.FileNotFound):
        plink.bed_info(str(tmp_path / "none"))
    raw = open(prefix + ".bed", "rb").read()
    open(prefix + ".bed", "wb").write(b"\0" + raw[1:])
    with pytest.raises(e.FileFormatError):
        plink.bed_info(prefix)
    open(prefix + ".bed", "wb").write(raw[:-1])
    with pytest.raises(e.FileFormatError):
        plink.bed_info(prefix)
    open(prefix + ".bed", "wb").write(raw + b"\0")
    assert plink.bed_info(prefix).loci == 4
    with pytest.raises(Exception, match="isn't within"):
        plink.read_bed(spark, prefix, start=3, end=9).collect()
    open(prefix + ".bim", "w").write("1 rs1 0 x A T\n")
    with pytest.raises(e.ParseError):
        plink.read_bim(spark, prefix + ".bim")
    open(prefix + ".bim", "w").write("1 rs1 0 5 A\n")
    with pytest.raises(e.ColumnCountError):
        plink.read_bim(spark, prefix + ".bim")


def test_frames(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("FID,IID,value_a,value_b\r\nf1,s1,1.5,10.0\r\nf2,s2,NA,20.0\nf3,s3,2.0,NA\n")
    assert [tuple(r) for r in tables.read_frame(spark, str(p)).collect()] == [("f1", "s1", 1.5, 10.0)]
    full = tables.read_frame(spark, str(p), missing="default").orderBy("iid").collect()
    assert [(r["value_a"], r["value_b"]) for r in full] == [(1.5, 10), (0, 20), (2, 0)]
    assert tables.read_frame(spark, str(p), "string").count() == 1
    for text, kind in (("ID IID y\na b 1\n", e.HeaderError), ("FID\tIID\n", e.HeaderError), ("FID\tIID\ty\na\tb\n", e.ColumnCountError), ("FID\tIID\ty\na\tb\tzz\n", e.ParseError), ("FID\tIID\ty\na\tb\t1\na\tb\t2\n", e.DataError), ("", e.EmptyFile)):
        p.write_text(text)
        with pytest.raises(kind):
            tables.read_frame(spark, str(p))
    with pytest.raises(e.FileNotFound):
        tables.read_frame(spark, str(tmp_path / "no"))
    with pytest.raises(e.FileOpenError):
        tables.read_frame(spark, str(tmp_path))


def test_effects_and_params(spark, tmp_path):
    p = tmp_path / "m.snp.eff"
    p.write_text("Index\tID\tChrom\tPosition\tA1\tA2\tA1Freq\tAdd\tPIP\tDom\tPIP\n1\trs1\t1\t5\tA\tT\t0.3\t0.1\t1\t0.2\t1\n2\trs2\t1\t6\tA\tT\tnan\t0.1\t1\t0\t1\n3\trs3\t1\t6\tA\tT\t0.2\tinf\t1\t0\t1\n")
    got = tables.read_effects(spark, str(p)).collect()
    assert len(got) == 1 and (got[0]["snp_id"], got[0]["add"], got[0]["dom"], got[0]["pos"]) == ("rs1", 0.1, 0.2, 5)
    assert tables.distinct_names(["pi_0", "PIP", "Dom", "pi_0", "PIP"]) == ["pi_0", "PIP", "Dom", "dom_pi_0", "dom_PIP"]
    p.write_text("ID\tA1\n")
    with pytest.raises(e.HeaderError):
        tables.read_effects(spark, str(p))
    q = tmp_path / "m.params"
    tables.write_params([("Intercept", 1.5, 0.1), ("age", 0.2, 0.1), ("sex_M", 0.3, 0.1), ("sex_F", 0, 0)], str(q))
    q.write_text(q.read_text() + "broken\n")
    assert tables.read_params(str(q)) == (1.5, {"age": 0.2}, {"sex": {"M": 0.3, "F": 0.0}})
    q.write_text("term\tmean\nage\t1\n")
    with pytest.raises(e.DataError):
        tables.read_params(str(q))


def test_grm_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(6, 6))
    m = a @ a.T + 2 * np.eye(6)
    ids = [(f"fam{i}", str(i)) for i in range(6)]
    prefix = str(tmp_path / "address" / "g.add")
    (tmp_path / "address").mkdir()
    binary.write_grm(prefix, m, ids)
    assert binary.grm_kind(prefix) == "add"
    f4 = m.astype("<f4").astype(float)
    assert np.allclose(binary.load_grm(prefix, None, False), np.tril(f4) + np.tril(f4, -1).T)
    sub = binary.load_grm(prefix, [ids[4], ids[1]])
    assert np.trace(sub) / 2 == pytest.approx(1) and sub[0, 1] == pytest.approx(f4[4, 1] / (f4[4, 4] + f4[1, 1]) * 2)
    cells = {(r["i"], r["j"]): r["value"] for r in binary.read_grm(spark, prefix).collect()}
    assert len(cells) == 21 and cells[5, 2] == f4[5, 2]
    with pytest.raises(e.DataError):
        binary.load_grm(prefix, [("q", "q")])
    binary.write_grm(prefix + ".chr1", m / 4, ids)
    assert np.allclose(binary.load_loco_grm(prefix, "1"), (m - m / 4) / (np.trace(m) / 6 * 0.75), rtol=1e-5)
    open(prefix + ".bin", "ab").write(b"\0")
    with pytest.raises(e.FileFormatError):
        binary.load_grm(prefix)
    with pytest.raises(e.InvalidArgument):
        binary.write_grm(prefix, m[:2], ids)


def test_encoded_and_chains(tmp_path):
    z = np.arange(12.0).reshape(4, 3)
    prefix = str(tmp_path / "z")
    binary.write_encoded(prefix, z, z.mean(0), z.std(0), np.array([2]))
    back, means, sds, mono = binary.read_encoded(prefix)
    assert np.array_equal(back, z) and np.array_equal(means, z.mean(0)) and np.array_equal(sds, z.std(0)) and mono.tolist() == [2]
    with pytest.raises(e.InvalidArgument):
        binary.write_encoded(prefix, z, z.mean(0), z.std(0), np.array([3]))
    open(prefix + ".bmat", "ab").write(b"\0")
    with pytest.raises(e.FileFormatError):
        binary.read_encoded(prefix)
    for dtype in (1, 2, 3):
        path = str(tmp_path / f"c{dtype}")
        w = binary.ChainWriter(path, 3, dtype)
        for k in range(4):
            w.write([k, k + 1, k + 2])
        with pytest.raises(e.InvalidArgument):
            w.write([1])
        w.finish()
        with pytest.raises(e.InvalidState):
            w.write([1, 2, 3])
        got = binary.read_chain(path)
        assert got.shape == (3, 4) and got[:, 2].tolist() == [2, 3, 4]
        assert struct.unpack("<QQ", open(path, "rb").read()[12:28]) == (3, 4)
        open(path, "ab").write(b"\0")
        with pytest.raises(e.FileFormatError):
            binary.read_chain(path)


def test_lines_are_written_by_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    from heritas.sources import tables

    def refuse(*a, **b):
        raise AssertionError("rows came to the driver")

    rows = spark.range(5000).selectExpr("id AS k", "CAST(id AS string) AS a", "CASE WHEN id % 7 > 0 THEN id / 4 END AS b").repartition(7)
    want = "a\tb\n" + "".join(f"{i}\t{i / 4 if i % 7 else None}\n" for i in range(5000))
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "toLocalIterator", refuse)
        m.setattr(type(rows), "toLocalIterator", refuse)
        tables.write_lines(rows, str(tmp_path / "x"), ["a", "b"], "k")
    assert (tmp_path / "x").read_text() == want and [p.name for p in tmp_path.iterdir()] == ["x"]
    monkeypatch.setattr(tables, "shared", lambda *a: False)
    tables.write_lines(rows, str(tmp_path / "y"), ["a", "b"], "k")
    assert (tmp_path / "y").read_text() == want
