"""Late rows: the same ones however a stream is cut into batches, also when a batch is run again."""

import datetime
import json
import os
import random

import pytest

from lectern.streaming import jobs

START = datetime.datetime(2024, 1, 1)


@pytest.fixture()
def arrivals(tmp_path):
    draw, rows = random.Random(3), []
    for seq in range(120):
        seconds = seq * 10 - (draw.randint(0, 400) if draw.random() < 0.3 else 0)
        rows.append((seq, None if seq == 50 else START + datetime.timedelta(seconds=seconds)))
    (tmp_path / "in").mkdir()
    for i in range(6):
        path = tmp_path / f"in/{i}.json"
        path.write_text("".join(json.dumps({"seq": s, "ts": t and t.isoformat()}) + "\n" for s, t in rows[i * 20:(i + 1) * 20]))
        os.utime(path, (1_700_000_000 + i * 10,) * 2)
    newest, late = None, set()
    for seq, ts in rows:
        if ts is not None:
            if newest is not None and ts < newest - datetime.timedelta(seconds=120):
                late.add(seq)
            newest = max(ts, newest or ts)
    return str(tmp_path), late


def test_late_rows_do_not_depend_on_batches(spark, arrivals):
    folder, want = arrivals
    assert 5 < len(want) < 60
    for files in (2, 6):
        early, late, fails = {}, {}, [files == 2]

        def keep(into):
            return lambda df, number: into.__setitem__(number, {r.seq for r in df.collect()})

        def keep_late(df, number):
            keep(late)(df, number)
            if number == 1 and fails and fails.pop():
                raise RuntimeError("lost")

        def run():
            stream = spark.readStream.schema("seq long, ts timestamp").option("maxFilesPerTrigger", files).json(f"{folder}/in")
            jobs.write_with_late_rows(stream, keep(early), keep_late, f"{folder}/c{files}", 120, ["seq"]).awaitTermination()

        if files == 2:
            with pytest.raises(Exception, match="lost"):
                run()
            fails.append(False)
        run()
        assert len(late) == 6 // files
        assert set().union(*late.values()) == want
        assert set().union(*early.values()) == set(range(120)) - want
