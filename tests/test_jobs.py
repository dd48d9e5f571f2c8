"""The data-production jobs, small."""

from tidemark import jobs


def counts(df):
    return {r[0]: r.rows for r in df.collect()}


def test_warehouse(spark, tmp_path):
    out = f"{tmp_path}/w"
    assert counts(jobs.warehouse(spark, out, 10, 5, 20)) == {"customers": 10, "products": 5, "orders": 20}
    assert counts(jobs.warehouse(spark, out, 99, 99, 99)) == {"customers": 10, "products": 5, "orders": 20}
    assert counts(jobs.warehouse(spark, out, 12, 5, 20, force=True)) == {"customers": 12, "products": 5, "orders": 20}


def test_sources(spark, tmp_path):
    found = counts(jobs.sources(spark, f"{tmp_path}/s", 100))
    assert found == {"A": 80, "B": 46, "C": 48}


def test_basic_sources(spark, tmp_path):
    assert counts(jobs.basic_sources(spark, f"{tmp_path}/b", 10)) == {s: 20 for s in ("source_a", "source_b", "source_c")}


def test_baseline(spark, tmp_path):
    assert counts(jobs.baseline(spark, f"{tmp_path}/l", 50)) == {"baseline": 50}
    assert {p.name for p in (tmp_path / "l").iterdir() if p.is_dir()} == {"day=2024-01-01"}


def test_command_line(spark, tmp_path, capsys):
    jobs.main(["sources", f"{tmp_path}/c", "--entities", "30"])
    assert "A" in capsys.readouterr().out
