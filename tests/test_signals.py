"""The JSON-lines source and sink: restarts and retried commits lose and repeat nothing."""

import json

import pytest

from tidemark.sources import signals


@pytest.fixture
def source(spark):
    spark.dataSource.register(signals.JsonLines)
    return spark


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) + "\n" for r in rows))


def test_lines_of_any_kind(source, tmp_path):
    put(tmp_path / "in", "a.jsonl", [{"seq": 1, "ts": 2, "kind": "tick", "title": "é\n"}, "not json\n", "[1]\n", "\n", {"seq": "x", "ts": True, "text": 5, "other": {}}, {}])
    put(tmp_path / "in", "b.jsonl", [{"seq": 1 << 40, "kind": None}, '{"seq": 7}'])  # the last line has no end
    put(tmp_path / "in", "_hidden.jsonl", [{"seq": 9}])
    got = source.read.format("tidemark_jsonl").load(f"file://{tmp_path}/in")
    assert got.columns == ["seq", "ts", "kind", "bundle", "app", "title", "text"]
    assert sorted(((r.seq, r.ts, r.kind, r.title) for r in got.collect()), key=str) == sorted([(1, 2.0, "tick", "é\n"), (None, None, None, None), (None, None, None, None), (1 << 40, None, None, None), (7, None, None, None)], key=str)
    assert source.read.format("tidemark_jsonl").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no plain values"):
        source.read.format("tidemark_jsonl").schema("a array<int>").load(str(tmp_path / "in")).count()


def test_batch_write_adds(source, tmp_path):
    df = source.createDataFrame([(i, f"é{i}") for i in range(9)], "seq long, text string").repartition(3)
    for _ in range(2):
        df.write.format("tidemark_jsonl").mode("append").save(f"{tmp_path}/out")
    got = source.read.format("tidemark_jsonl").load(f"{tmp_path}/out")
    assert sorted((r.seq, r.text) for r in got.collect()) == sorted([(i, f"é{i}") for i in range(9)] * 2)


def test_a_restart_loses_and_repeats_nothing(source, tmp_path):
    def run():
        df = source.readStream.format("tidemark_jsonl").load(f"{tmp_path}/in")
        q = df.select("seq", "text").repartition(2).writeStream.format("tidemark_jsonl").option("checkpointLocation", f"{tmp_path}/ck").trigger(once=True).start(f"{tmp_path}/out")
        q.awaitTermination(100)

    seq, want = 0, []
    for batch in range(3):
        for part in range(2):
            rows = [{"seq": seq + i, "text": f"t{seq + i}"} for i in range(5)]
            seq += 5
            want += [r["seq"] for r in rows]
            put(tmp_path / "in", f"{batch}-{part}.jsonl", rows)
        run()
        if batch == 1:  # the commit log loses its last entry: the batch runs again
            for log in (tmp_path / "ck" / "commits").iterdir():
                if log.name.lstrip(".").startswith("1"):
                    log.unlink()
            run()
    run()
    got = source.read.format("tidemark_jsonl").load(f"{tmp_path}/out")
    assert sorted(r.seq for r in got.collect()) == want
    assert list((tmp_path / "out" / "_aside").iterdir()) == []


def test_a_commit_that_broke_off_is_done_again(tmp_path):
    w = signals.StreamWriter(f"file://{tmp_path}")
    from pyspark.sql import Row

    first = [w.write(iter([Row(seq=i)])) for i in range(3)]
    w.put(first[:2], "batch-000000000000")  # lost before the third file and the mark
    again = [w.write(iter([Row(seq=i)])) for i in range(3)] + [w.write(iter([]))]
    w.commit(again, 0)
    assert len(signals.names(f"file://{tmp_path}")) == 3
    w.commit([w.write(iter([Row(seq=9)]))], 0)  # committed already
    w.abort([first[2], None], 0)
    assert len(signals.names(f"file://{tmp_path}")) == 3 and list((tmp_path / "_aside").iterdir()) == []
