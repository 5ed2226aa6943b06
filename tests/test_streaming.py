"""Incremental loads: only new files are processed; replays do not duplicate."""

import shutil

from microstar.plans import exam
from microstar.streaming.ingest import stream_cleaned, stream_curated
from tests import exam_fixtures as X


def test_stream_cleaned_then_curated(spark, tmp_path):
    raw_dir, batch_src = tmp_path / "incoming", tmp_path / "staging"
    raw_dir.mkdir()
    batch_src.mkdir()
    rows = X.rows_2019()
    first = X.write_raw(str(batch_src), 2019, rows[:2])
    shutil.move(first, raw_dir / "part1.csv")
    out, ck = str(tmp_path / "cleaned"), str(tmp_path / "ck_cleaned")
    q = stream_cleaned(spark, str(raw_dir), 2019, out, ck)
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 2

    second = X.write_raw(str(batch_src), 2019, rows[2:])
    shutil.move(second, raw_dir / "part2.csv")
    q = stream_cleaned(spark, str(raw_dir), 2019, out, ck)          # restart from the checkpoint
    q.awaitTermination()
    cleaned = spark.read.parquet(out)
    assert cleaned.count() == len(rows)                             # no file read twice
    batch = exam.clean(exam.read_raw(spark, str(raw_dir), 2019), 2019)
    assert sorted(map(tuple, cleaned.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))

    cur, ck2 = str(tmp_path / "curated"), str(tmp_path / "ck_curated")
    stream_curated(spark, out, 2019, cur, ck2).awaitTermination()
    cad = spark.read.parquet(f"{cur}/DIM_CADASTRAL")
    assert sorted(r["NUM_INS"] for r in cad.collect()) == ["190000000001", "190000000002", "190000000003"]
    assert spark.read.parquet(f"{cur}/_rejects/DIM_CADASTRAL").count() == 1


def test_replayed_batch_does_not_duplicate(spark, tmp_path):
    from microstar.streaming.ingest import write_star_batch
    raw = X.write_raw(str(tmp_path), 2019, X.rows_2019())
    batch = exam.clean(exam.read_raw(spark, raw, 2019), 2019)
    out = str(tmp_path / "cur")
    write_star_batch(batch, 7, 2019, out)
    write_star_batch(batch, 7, 2019, out)                          # the same batch id delivered again
    assert spark.read.parquet(f"{out}/DIM_PRESENCA").count() == 4
    write_star_batch(batch.limit(1), 8, 2019, out)                 # a new batch adds rows
    assert spark.read.parquet(f"{out}/DIM_PRESENCA").count() >= 4
    assert {r[0] for r in spark.read.parquet(f"{out}/DIM_PRESENCA").select("_batch").distinct().collect()} == {7, 8}


def test_stream_cleaned_rejects_malformed_lines(spark, tmp_path):
    raw_dir = tmp_path / "incoming"
    raw_dir.mkdir()
    path = X.write_raw(str(tmp_path), 2019, X.rows_2019()[:1])
    with open(path, "a", encoding="iso-8859-1") as fh:
        row = X.base_row(2019, "190000000077")
        row["NO_MUNICIPIO_PROVA"] = "Boa Vista;RR"                 # shifts every later field
        fh.write(";".join(row.get(c, "") or "" for c in X.LAYOUTS[2019]) + "\n")
    shutil.move(path, raw_dir / "part.csv")
    out = str(tmp_path / "cleaned")
    stream_cleaned(spark, str(raw_dir), 2019, out, str(tmp_path / "ck")).awaitTermination()
    assert [r["NUM_INS"] for r in spark.read.parquet(out).collect()] == ["190000000001"]
    rej = spark.read.parquet(out + "_rejects/raw").collect()
    assert [(r["NU_INSCRICAO"], r["_reject_reason"]) for r in rej] == [("190000000077", exam.MALFORMED)]
