"""CSV files of any headers: one scan, large files in pieces, records over their bounds."""

import csv
import io
import random

import pytest

from lanewise.sources import csv_log
from lanewise.sources.board_log import CSV_COLUMNS


def table(rng, n, seed):
    """A file's text and its records as dicts; columns and order are its own."""
    known = [c for c in CSV_COLUMNS if c not in ("id", "date", "data.card.closed", "data.card.due", "data.list.closed")]
    columns = ["id", "date", *rng.sample(known, rng.randint(1, len(known))), *(f"extra {seed} {k}" for k in range(rng.randint(0, 3)))]
    rng.shuffle(columns)
    texts = ["", "plain", 'say "hi"', "two\nlines", 'a,"b"\n\n"c', "\n", '"', '""', "é\r\nü", "x" * 50]
    rows = []
    for k in range(n):
        row = {c: rng.choice(texts) for c in columns} | {"id": f"{seed}-{k}", "date": "2024-01-01 00:00:00"}
        rows.append(row)
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    w.writerow(["", *columns])
    for k, row in enumerate(rows):
        w.writerow([k, *(row[c] for c in columns)])
    return out.getvalue(), rows


@pytest.mark.parametrize("split,piece", [("128m", 1 << 20), ("1500", 1 << 20), ("900", 150), ("900", 1)])
def test_files_in_any_pieces(spark, tmp_path, split, piece):
    rng = random.Random(7)
    want = {}
    for f in range(6):
        text, rows = table(rng, (0, 1, 30)[f % 3], f)
        (tmp_path / f"b {f}+.csv").write_bytes(text.encode())
        want |= {r["id"]: (f"b {f}+", -k, r) for k, r in enumerate(rows)}
    (tmp_path / "empty.csv").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1" if split != "128m" else "4m")
    try:
        if piece == 1:
            with pytest.raises(Exception, match="header of a file"):
                (tmp_path / "wide.csv").write_text('"a\nb",id\n' + "0,1\n" * 2000)
                csv_log.read_csv(spark, str(tmp_path), piece=piece).collect()
            return
        got = {r["id"]: r for r in csv_log.read_csv(spark, str(tmp_path), piece=piece).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert set(got) == set(want)
    for i, (board, pos, row) in want.items():
        assert (got[i]["board_id"], got[i]["pos"]) == (board, pos)
        for old, new in CSV_COLUMNS.items():
            if old not in ("date",):
                assert got[i][new] == (row.get(old) or None), (i, old)


def test_many_headers_are_one_scan(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"{k}.csv").write_text(f",id,date,own {k},data.list.id\n0,a{k},2024-01-01 00:00:00,x,L{k}\n")
    got = csv_log.read_csv(spark, str(tmp_path))
    assert sorted((r["board_id"], r["id"], r["list_id"]) for r in got.collect()) == sorted((str(k), f"a{k}", f"L{k}") for k in range(60))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_cut():
    assert csv_log.cut('h,"i\nj"\na,b\nc,"d', False, True) == [(3, 'h,"i\nj"'), (1, "a,b"), (2, 'c,"d')]
    assert csv_log.cut('e"\nf,g', True, False) == [(0, 'e"'), (1, "f,g")]
    assert csv_log.cut("all\ninside", True, False) == [(0, "all\ninside")]
