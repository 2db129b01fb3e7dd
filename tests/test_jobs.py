"""The jobs: growing input, stopped runs, reruns, settings and the command line."""

import json
import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, kmer_spectrum, queries, select_reads
from strandloom.operators import kmers
from strandloom.sources import adapters

SCHEMA = "doc_id bigint, text string, source string, k string, prefix string"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def rows():
    """Reads of a genome with errors, as letters that stand for bases, so that the histogram has a valley; and odd ones."""
    rng = random.Random(5)
    genome = "".join(rng.choice("abcd") for _ in range(4000))
    out = []
    for i in range(420):
        at = rng.randrange(3600)
        s = list(genome[at : at + rng.randint(150, 400)])
        for _ in range(rng.randrange(3)):
            s[rng.randrange(len(s))] = rng.choice("abcd")
        out.append((i, "".join(s), f"cell{i % 3}", "x", "y"))
    return out + [(420, None, None, None, None), (421, "", "cell0", None, None), (422, "short", "cell1", None, None), (423, "a" * 30000, "cell2", None, None)]


def deliver(spark, rows, path, files=1):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(path)


def table(df):
    return sorted(map(tuple, df.collect()), key=str)


def whole(spark, rows, k, prefix):
    counts = kmers.code_counts(adapters.reads_from_documents(spark.createDataFrame(rows, SCHEMA)), k)
    return table(counts.select("code", "n", F.substring(kmers.decoded(F.col("code"), k), 1, prefix).alias("prefix")))


def test_spectrum_of_growing_input(spark, rows, tmp_path, caplog):
    caplog.set_level("INFO", logger="jobs")
    reads, out = str(tmp_path / "reads"), str(tmp_path / "out")
    config = {"k": 11, "prefix": 3, "files_per_batch": 2}
    deliver(spark, rows[:100], reads, 3)
    assert table(kmer_spectrum.run(spark, reads, out, config)) == whole(spark, rows[:100], 11, 3)
    assert "took 100 new rows" in caplog.text and "batch 1 in place 1" in caplog.text
    caplog.clear()
    deliver(spark, rows[100:], reads, 2)
    settings = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    assert table(kmer_spectrum.run(spark, reads, out, config)) == whole(spark, rows, 11, 3)
    assert settings == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))
    assert f"took {len(rows) - 100} new rows" in caplog.text and "in place 0" in caplog.text
    got = {r["source"]: (r["reads"], r["bases"]) for r in kmer_spectrum.yields(spark, out).collect()}
    want = {s: (sum(r[2] == s for r in rows), sum(len(r[1] or "") for r in rows if r[2] == s)) for s in {r[2] for r in rows}}
    assert got == want
    # nothing new: nothing is written
    caplog.clear()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "totals").rglob("*.parquet")}
    assert table(kmer_spectrum.run(spark, reads, out, config)) == whole(spark, rows, 11, 3)
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "totals").rglob("*.parquet")} and "wrote" not in caplog.text
    lines = "".join(p.read_text() for p in (tmp_path / "out" / "histogram").glob("part-*")).splitlines()[1:]
    assert {tuple(map(int, x.split(","))) for x in lines} == set(Counter(n for _, n, _ in whole(spark, rows, 11, 3)).items())
    with pytest.raises(ValueError, match="another k"):
        kmer_spectrum.run(spark, reads, out, config | {"k": 12})


def test_stopped_spectrum_goes_on(spark, rows, tmp_path, monkeypatch):
    """Stops before the totals, between totals and mark, and inside a micro-batch; each time the next run has it right."""
    reads, out = str(tmp_path / "reads"), str(tmp_path / "out")
    config = {"k": 11, "prefix": 1}
    taken = 0
    for stop, n in (("add_to_totals", 100), ("set_mark", 220), ("batch", 330), (None, len(rows))):
        deliver(spark, rows[taken:n], reads)
        taken = n
        with monkeypatch.context() as m:
            if stop == "set_mark":
                m.setattr(kmer_spectrum, "set_mark", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
            elif stop == "add_to_totals":
                m.setattr(kmer_spectrum, "add_to_totals", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
            elif stop == "batch":
                def half(df, write, what):
                    if "yields" in what:
                        raise RuntimeError("stopped")
                    return common.counted(df, write, what)

                m.setattr(kmer_spectrum, "counted", half)
            if stop:
                with pytest.raises((KeyboardInterrupt, Exception)):
                    kmer_spectrum.run(spark, reads, out, config)
        assert table(kmer_spectrum.run(spark, reads, out, config)) == whole(spark, rows[:n], 11, 1)
    assert kmer_spectrum.yields(spark, out).agg(F.sum("reads")).first()[0] == len(rows)


def test_spectrum_of_one_file_and_of_none(spark, rows, tmp_path):
    reads, out = tmp_path / "reads", str(tmp_path / "out")
    deliver(spark, rows[:50], str(reads))
    one = str(next(reads.glob("part-*")))
    assert table(kmer_spectrum.run(spark, one, out, {"k": 5})) == whole(spark, rows[:50], 5, 2)
    deliver(spark, rows[:0], str(tmp_path / "empty"))
    assert kmer_spectrum.run(spark, str(tmp_path / "empty"), str(tmp_path / "out2"), {"k": 5}).count() == 0
    assert kmer_spectrum.totals(spark, str(tmp_path / "no")).count() == kmer_spectrum.yields(spark, str(tmp_path / "no")).count() == 0
    with pytest.raises(ValueError, match="prefix"):
        kmer_spectrum.run(spark, one, out, {"prefix": 0})


def test_selected_reads(spark, rows, tmp_path):
    reads, out, spectrum = (str(tmp_path / x) for x in ("reads", "out", "spectrum"))
    deliver(spark, rows, reads, 4)
    config = {"k": 21, "coverage": 0.1, "min_overlap": 20, "cover": "rounds"}
    first = select_reads.run(spark, reads, out, config)
    got = table(first)
    assert len(got) == len(rows) and {r["read_id"] for r in first.collect()} == {str(r[0]) for r in rows}
    assert table(select_reads.run(spark, reads, out, config)) == got
    # reads are dealt out once, not by each step that takes them
    dealt, barcodes = [], select_reads.B.barcodes
    with pytest.MonkeyPatch.context() as m:
        m.setattr(select_reads.B, "barcodes", lambda r, *a: dealt.append("RoundRobin" in r._jdf.queryExecution().toString()) or barcodes(r, *a))
        assert table(select_reads.run(spark, reads, out, config)) == got
    assert dealt == [False]
    kmer_spectrum.run(spark, reads, spectrum, {"k": 21})
    place = kmer_spectrum.last_mark(spark, spectrum)["place"]
    first = select_reads.run(spark, reads, out, config, f"{spectrum}/totals/place={place}")
    assert table(first) == got
    chosen = first.where("selected")
    assert chosen.where("not is_anchor and not is_bridge and bin_id > 200").count() == 0 < chosen.count() < len(rows)
    fasta = "".join(p.read_text() for p in (tmp_path / "out" / "fasta").glob("part-*"))
    assert fasta.count(">") == chosen.count()
    assert {p.name for p in (tmp_path / "out" / "reads").glob("bin_id=*")} == {f"bin_id={r[0]}" for r in first.select("bin_id").distinct().collect()}
    for bad in ({"cover": "all"}, {"k": 40}, {"genome_size": 10}):
        with pytest.raises(ValueError):
            select_reads.run(spark, reads, out, bad)


def test_settings(spark, tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"k": 15, "coverage": 2}))
    assert common.settings(spark, str(file), select_reads.KNOWN) == select_reads.KNOWN | {"k": 15, "coverage": 2}
    for bad, match in (({"kk": 1}, "unknown"), ({"k": "x"}, "kind")):
        file.write_text(json.dumps(bad))
        with pytest.raises(ValueError, match=match):
            common.settings(spark, str(file), select_reads.KNOWN)
    for name in ("select_reads", "kmer_spectrum"):
        assert common.settings(spark, str(ROOT / "jobs" / f"{name}.json"), {"select_reads": select_reads, "kmer_spectrum": kmer_spectrum}[name].KNOWN)


def test_command_line(spark, rows, tmp_path):
    reads, out = str(tmp_path / "reads"), str(tmp_path / "out")
    deliver(spark, rows[:60], reads)
    done = subprocess.run([sys.executable, "-m", "jobs.kmer_spectrum", "--config", "jobs/kmer_spectrum.json", "--reads", reads, "--out", out], cwd=ROOT, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "took 60 new rows" in done.stderr and table(kmer_spectrum.totals(spark, out)) == whole(spark, rows[:60], 21, 2)


def test_queries_run_twice_in_new_folders(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(kmer_spectrum, "run", lambda s, reads, out, config: seen.append((reads, out)))
    for _ in range(2):
        queries.job2_kmer_spectrum(spark, "/data")
    assert seen[0] == seen[1] and seen[2] == seen[3] and seen[0][1] != seen[2][1] and seen[0][0] == "/data/documents.parquet"
    assert set(queries.queries()) == set(queries.oracle_sql())


def test_batches_bring_packed_runs(spark, tmp_path):
    """A batch leaves packed bases, not a row for each of its k-mers, and the first totals are not shuffled by code."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcd") for _ in range(2000)), "s") for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "reads"))
    out = str(tmp_path / "out")
    found = kmer_spectrum.run(spark, str(tmp_path / "reads"), out, {"k": 21})
    new = spark.read.parquet(f"{out}/new")
    assert set(new.columns) == {"bucket", "runs", "batch"} and new.count() < found.count() / 2
    assert found.count() == found.select("code").distinct().count() > 70_000
