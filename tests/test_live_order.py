"""Live held flags on samples that land out of order, against the batch rule row by row."""

import random
from datetime import datetime, timedelta

from welltide.streaming import live

START = datetime(2024, 1, 1)


def model(values, n, held=None, run=0):
    out = []
    for v in values:
        up = v >= 40
        if held is None:
            held, run = up, 0
        elif up == held:
            run = 0
        else:
            run += 1
            if run >= n - 1:
                held, run = up, 0
        out.append(held)
    return out


def land(path, rows):
    path.write_text("".join(f"{w}\t{t:%Y-%m-%d %H:%M:%S}\t{k}={v}\n" for w, k, t, v in rows))


def test_rows_shuffled_over_triggers_and_a_state_to_go_on_from(spark, tmp_path):
    rng, folder = random.Random(4), tmp_path / "in"
    folder.mkdir()
    live.rocks(spark)
    rows = [(w, "0130", START + timedelta(minutes=7 * i + rng.randint(0, 6)), float(rng.choice([30, 35, 45, 50]))) for w in ("1", "2") for i in range(400)]
    rows.sort(key=lambda r: r[2])
    landed = sorted(rows, key=lambda r: r[2] + timedelta(minutes=rng.randint(0, 300)))
    size = len(landed) // 5
    before = spark.createDataFrame([("2", "0130", True, 1)], "well_id string, wits_id string, held boolean, run int")
    for i in range(5):  # one run of the stream for each batch of files
        land(folder / f"{i}.txt", landed[i * size:(i + 1) * size])
        d = live.read_landing(spark, str(folder), 1, "6 hours")
        live.run_available(live.held_flags_in_order(d, 40.0, 3, before, "30 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ts", "value").collect():
        got.setdefault(r.well_id, []).append((r.ts, r.value, r.held))
    mark = rows[-1][2] - timedelta(hours=6)
    for w in ("1", "2"):
        mine = sorted((t, v) for x, _, t, v in rows if x == w)
        flags = model([v for _, v in mine], 3, *((True, 1) if w == "2" else ()))
        want = [(t, v, h) for (t, v), h in zip(mine, flags, strict=True) if t.replace(minute=t.minute // 30 * 30, second=0) + timedelta(minutes=30) <= mark]
        assert got[w] == want and len(want) > 300


def test_flag_goes_when_a_well_is_idle(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    live.rocks(spark)
    at = lambda h: START + timedelta(hours=h)
    steps = [[("1", "0130", at(0), 50.0)], [("2", "0130", at(100), 50.0)], [("1", "0130", at(101), 30.0), ("2", "0130", at(101), 30.0)], [("3", "0130", at(200), 1.0)]]
    for i, rows in enumerate(steps):
        land(folder / f"{i}.txt", rows)
        live.run_available(live.held_flags_in_order(live.read_landing(spark, str(folder), 1), 40.0, 3, idle="24 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.well_id, r.ts): r.held for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # Well 1 begins again after its day of rest, well 2 still holds its flag.
    assert got == {("1", at(0)): True, ("2", at(100)): True, ("1", at(101)): False, ("2", at(101)): True}
