"""Sessions over a stream: late turns fall into place, expired memory is gone, as in the batch form."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

from quillgraph.streaming.sessions import expiring_session_context, stream_sessions

SCHEMA = "session_id bigint, turn bigint, question string, at timestamp"


def test_a_stream_of_late_and_expired_turns_equals_the_batch(spark, tmp_path):
    rng, begin = random.Random(2), datetime(2026, 1, 1, tzinfo=timezone.utc)
    rows = []
    for s in range(6):
        at = begin + timedelta(minutes=s)
        for turn in range(12):
            at += timedelta(minutes=rng.choice([1, 2, 3, 90]))
            rows.append((s, turn, f"q{s}.{turn}", at))
    want = {tuple(r) for r in expiring_session_context(spark.createDataFrame(rows, SCHEMA), 3600).collect()}
    assert len(want) == 72 and len({x[3].split(" ")[0] for x in want if x[0] == 0}) > 1
    # arrival: nearly in order of time, some up to eight minutes late; one turn far too late is dropped
    arrival = sorted(rows, key=lambda r: r[3] + timedelta(minutes=rng.choice([0, 0, 0, 8])))
    arrival += [(99, 0, "the end", max(r[3] for r in rows) + timedelta(days=2)), (0, 50, "much too late", begin), (98, 0, "after", max(r[3] for r in rows) + timedelta(days=4))]
    (tmp_path / "in").mkdir()
    files = [arrival[k : k + 15] for k in range(0, len(rows), 15)] + [[r] for r in arrival[len(rows) :]]
    files[-4] = files[-4][: len(rows) % 15 or 15]
    for k, part in enumerate(files):
        path = tmp_path / "in" / f"{k:04d}.json"
        path.write_text("\n".join(json.dumps({"session_id": s, "turn": t, "question": q, "at": a.isoformat()}) for s, t, q, a in part))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = stream_sessions(stream, "10 minutes", 3600)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.session_id < 98}
    assert got == want
