import pytest

from lumenflow import cli


def test_generated_platform_to_features_and_report(spark, tmp_path, capsys):
    out = str(tmp_path / "data")
    cli.main(["generate", "--out", out, "--users", "12", "--videos", "8", "--sessions", "20", "--minutes", "2"])
    cli.main(["features", "--source", out, "--out", str(tmp_path / "f"), "--window-end", "2026-01-31T18:10"])
    rows = spark.read.parquet(f"{tmp_path}/f/refresh_ts=202601311810").collect()
    assert len(rows) == 12 and sum(r.f_stream_videos_started_30m for r in rows) >= 600
    cli.main(["bronze", "--source", out, "--out", str(tmp_path / "b"), "--batch", "x", "--ingest-ts", "2026-02-01", "--tables", "users"])
    assert spark.read.parquet(f"{tmp_path}/b/raw_users").count() == 12
    cli.main(["report", "--source", out])
    assert "PLAYBACK HISTORY" in capsys.readouterr().out
    cli.main(["schemas", "--out", str(tmp_path / "s")])
    with pytest.raises(SystemExit):
        cli.main(["features"])
