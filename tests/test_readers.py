"""Readers: CSV layouts of the original files, written from the test tables."""

import os
import tempfile

import pytest

from pyspark.sql import functions as F

from dyadic.sources import readers as RD


def _write_csv(path, header, rows):
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join(str(x) for x in r) + "\n")


def test_readers_roundtrip(spark, duck):
    d = tempfile.mkdtemp(prefix="dyadic-read-")
    sup = duck.sql("select s_suppkey, s_name from supplier order by s_suppkey desc").fetchall()
    _write_csv(f"{d}/drugs.csv", ["", "STITCH_id", "name", "pubchemID"],
               [(i, f"CID{k:09d}", n, k) for i, (k, n) in enumerate(sup)])
    drugs = RD.read_drug_csv(spark, f"{d}/drugs.csv")
    assert drugs.count() == len(sup)
    assert drugs.where(F.col("stitch_id") != F.concat(F.lit("CID"), F.lpad(F.col("drug_id").cast("string"), 9, "0"))).count() == 0

    _write_csv(f"{d}/se.csv", ["SE_map", "Side Effect Name"], [(0, "a"), (1, "b"), (0, "c")])
    assert dict(RD.read_side_effect_csv(spark, f"{d}/se.csv").collect()) == {0: "c", 1: "b"}

    li = duck.sql("select l_suppkey, l_partkey, l_linenumber, case when l_returnflag='R' then 1 else 0 end "
                  "from lineitem").fetchall()
    _write_csv(f"{d}/x.csv", ["drug1", "drug2", "SE"], [(a, b, c) for a, b, c, _ in li])
    _write_csv(f"{d}/y.csv", ["label"], [(y,) for *_, y in li])
    z = RD.read_pairs_zip(spark, f"{d}/x.csv", f"{d}/y.csv").orderBy("row_id").collect()
    assert [(r["drug1"], r["drug2"], r["se"], r["label"]) for r in z] == [tuple(t) for t in li]

    _write_csv(f"{d}/thr.csv", ["", "SE", "optimal_thr", "optimal_thr.1"], [(0, 0, 0.3, 0.4), (1, 1, 0.5, 0.6)])
    t = {(r["se"], r["sample_no"]): r["thr"] for r in RD.read_thresholds_csv(spark, f"{d}/thr.csv").collect()}
    assert t == {(0, 0): 0.3, (0, 1): 0.4, (1, 0): 0.5, (1, 1): 0.6}

    _write_csv(f"{d}/occ.csv", ["num_occur"], [(5.0,), (7.0,)])
    assert sorted(RD.read_occurrence_csv(spark, f"{d}/occ.csv").collect()) == [(0, 5), (1, 7)]

    _write_csv(f"{d}/genes.csv", ["", "0"], [(0, 16), (1, 23)])
    assert sorted(RD.read_gene_list(spark, f"{d}/genes.csv").collect()) == [(0, 16), (1, 23)]
    assert os.path.isdir(d)


def test_zip_over_several_part_files(spark, tmp_path):
    """X and y are cut into parts at different places; rows still meet by position."""
    rows = [(i, i % 7, i % 3, (i * 7919) % 2) for i in range(3000)]
    def write(name, cuts, line, header):
        d = tmp_path / name
        d.mkdir()
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
            (d / f"part-{k:05d}.csv").write_text(header + "\n" + "".join(line(r) + "\n" for r in rows[a:b]))
        return str(d)
    x = write("x", [2900, 2950], lambda r: f"{r[0]},{r[1]},{r[2]}", "drug1,drug2,SE")
    y = write("y", [50, 1700], lambda r: str(r[3]), "label")
    got = sorted(tuple(r) for r in RD.read_pairs_zip(spark, x, y).collect())
    assert got == [(i, *r) for i, r in enumerate(rows)]
    short = write("short", [10], lambda r: str(r[3]), "label")
    with open(f"{short}/part-00001.csv", "a") as f:
        f.write("1\n")
    with pytest.raises(ValueError):
        RD.read_pairs_zip(spark, x, short)


def test_profile_reader_reads_nan_as_missing_and_refuses_duplicates(spark, tmp_path):
    p = tmp_path / "profiles.csv"
    p.write_text("pubchem,a,b\n1,0.5,NaN\n2,,1.5\n")
    got = {r["drug_id"]: r["vec"] for r in RD.read_profile_csv(spark, str(p), 2).collect()}
    assert got == {1: [0.5, None], 2: [None, 1.5]}
    p.write_text("pubchem,a,b\n1,0.5,1\n1,2,1.5\n")
    with pytest.raises(ValueError):
        RD.read_profile_csv(spark, str(p), 2)
