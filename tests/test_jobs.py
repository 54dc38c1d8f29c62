import json

import pytest
from pyspark.sql import functions as F

from vocaris.streaming import jobs

GOOD = json.dumps({"collections": ["spkid_" + "a" * 24 + "_" + "b" * 24]})


def request(name, **more):
    return {"request_id": name, "path": "1.wav", "speaker_count": 0, "max_speaker": 0, "speaker_names": None} | more


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def made(spark, tmp_path, work):
    audio = tmp_path / "audio"
    (audio / "sub").mkdir(parents=True)
    for name, text in (("1.wav", "one"), ("2.wav", "two"), ("sub/3.wav", "one")):
        (audio / name).write_text(text)
    return jobs.JobStream(str(tmp_path / "out"), jobs.binary_content(spark, str(audio)), work, ceiling=50)


def upper(rows):
    return rows.select("key", F.concat(F.upper(F.col("content").cast("string")), F.lit(":"), F.coalesce(F.col("speaker_count"), F.lit(0)).cast("string")).alias("result"))


def run(stream, spark, intake):
    q = stream.start(stream.submit(spark, str(intake), maxFilesPerTrigger="1"))
    q.awaitTermination()


def test_requests_are_checked_answered_and_shared(spark, tmp_path):
    stream = made(spark, tmp_path, upper)
    write(tmp_path / "in", "a.json", [request("r1"), request("r2", path="sub/3.wav"), request("r3", path="2.wav", speaker_count=2, max_speaker=4), request("r4", path="none.wav"), request("r5", speaker_names="{}"), request("r6", path=None), request("r7", speaker_names=GOOD)])
    run(stream, spark, tmp_path / "in")
    write(tmp_path / "in", "b.json", [request("r8"), request("r9", speaker_count=3)])
    run(stream, spark, tmp_path / "in")
    got = {r.request_id: (r.status, r.result) for r in stream.answers(spark).collect()}
    assert got == {
        "r1": ("done", "ONE:0"), "r2": ("done", "ONE:0"), "r3": ("done", "TWO:2"), "r4": ("rejected", None), "r5": ("rejected", None),
        "r6": ("rejected", None), "r7": ("done", "ONE:0"), "r8": ("done", "ONE:0"), "r9": ("done", "ONE:3"),
    }
    keys = [r.key for r in stream.results(spark).collect()]
    assert len(keys) == len(set(keys)) == 4  # same content and counts: one job
    assert {r.batch for r in stream.results(spark).collect()} == {0, 1}


@pytest.mark.parametrize("where", ["work", "between", "after"])
def test_a_killed_and_restarted_stream_gives_each_job_once(spark, tmp_path, where, monkeypatch):
    seen = {"failed": False}

    def fragile(rows):
        if where == "work" and not seen["failed"] and rows.where("cast(content as string) = 'two'").count():
            seen["failed"] = True
            raise RuntimeError("killed")
        return upper(rows)

    stream = made(spark, tmp_path, fragile)
    real = jobs.JobStream.process

    def process(self, batch, number):
        if where == "between" and number == 1 and not seen["failed"]:
            seen["failed"] = True
            self_results = self.work(self._checked(batch).where("status = 'todo'"))
            self_results.select("key", "result").write.parquet(f"{self.folder}/results/batch={number}")  # results, but no status
            raise RuntimeError("killed")
        real(self, batch, number)
        if where == "after" and number == 1 and not seen["failed"]:
            seen["failed"] = True
            raise RuntimeError("killed")  # all is written, but the batch isn't committed

    monkeypatch.setattr(jobs.JobStream, "process", process)
    write(tmp_path / "in", "a.json", [request("r1")])
    run(stream, spark, tmp_path / "in")
    write(tmp_path / "in", "b.json", [request("r2", path="2.wav"), request("r3", path="2.wav"), request("r4")])
    with pytest.raises(Exception, match="killed"):
        run(stream, spark, tmp_path / "in")
    run(stream, spark, tmp_path / "in")
    rows = stream.status(spark).collect()
    assert sorted((r.request_id, r.status) for r in rows) == [(f"r{k}", "done") for k in (1, 2, 3, 4)]
    assert sorted(r.result for r in stream.results(spark).collect()) == ["ONE:0", "TWO:0"]


def test_failed_jobs_are_tried_again(spark, tmp_path):
    answers = {"now": False}
    stream = made(spark, tmp_path, lambda rows: upper(rows) if answers["now"] else upper(rows).where("false"))
    write(tmp_path / "in", "a.json", [request("r1")])
    run(stream, spark, tmp_path / "in")
    assert [(r.status, r.message) for r in stream.status(spark).collect()] == [("failed", "no result")]
    answers["now"] = True
    write(tmp_path / "in", "b.json", [request("r2")])
    run(stream, spark, tmp_path / "in")
    assert {r.request_id: r.status for r in stream.status(spark).collect()} == {"r1": "failed", "r2": "done"}
