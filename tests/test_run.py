"""Both jobs from landed files to written results."""

import datetime as dt
import json

import pytest

from murmur.plans import run


def lines(folder, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "part.json").write_text("\n".join(json.dumps(row) for row in rows))


def text(folder, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "part.txt").write_text(content)


def epoch(moment):
    return int(dt.datetime.fromisoformat(moment + "+00:00").timestamp())


@pytest.fixture
def landing(tmp_path):
    root = tmp_path / "landing"
    symbols = [{"symbol": s, "title": t} for s, t in (("TSLA", "Tesla Inc."), ("TINY", "Tiny Corp."))]
    text(root / "trending", json.dumps({"symbols": symbols}))
    row = "<tr valign='top'><td>{}</td><td>{}</td><td>{}</td></tr>"
    header = row.format("No.", "Ticker", "Company")
    menu = "<table><tr><td>1</td><td>NEWS</td><td>Menu</td></tr></table>"
    pages = [
        {"page": 0, "html": menu + "<table>" + header + row.format(1, "GME", "GameStop Corp.") + row.format(2, "TSLA", "Tesla") + "</table>"},
        {"page": 1, "html": menu + "<table>" + header + row.format(1, "GME", "GameStop Corp.") + row.format(2, "LATE", "Late") + "</table>"},
    ]
    lines(root / "screener", pages)
    caps = {"TSLA": "1.2T", "GME": "9B", "TINY": "20M", "LATE": "9B"}
    lines(root / "caps", [{"symbol": s, "cap_text": c} for s, c in caps.items()])
    text(root / "holidays", 'holiday,2024\nNew Year,"Monday, January 1"\n')
    lines(
        root / "comments",
        [
            {"id": 1, "created_utc": epoch("2024-01-02 11:00:00"), "body": "TSLA is great good"},
            {"id": 2, "created_utc": epoch("2024-01-02 11:01:00"), "body": "TSLA is great good"},
            {"id": 3, "created_utc": epoch("2024-01-02 01:00:00"), "body": "TSLA too old"},
            {"id": 4, "created_utc": epoch("2024-01-02 11:00:00"), "body": "[removed]"},
            {"id": 5, "created_utc": epoch("2024-01-02 11:00:00"), "body": "TSLAQ and xGME"},
        ],
    )
    lines(
        root / "stocktwits",
        [
            {"stock": "GME", "seq": 1, "created_utc": epoch("2024-01-01 12:00:00"), "raw": "u1\nBullish\n1m\nthis is the good one"},
            {"stock": "GME", "seq": 2, "created_utc": epoch("2024-01-01 12:00:00"), "raw": "u1\nBullish\n1m\nthe same user is here"},
            {"stock": "TSLA", "seq": 3, "created_utc": epoch("2024-01-01 12:00:00"), "raw": "u2\n1m\nthe trending window is over"},
            {"stock": "GME", "seq": 4, "created_utc": epoch("2024-01-01 12:00:00"), "raw": "u3\n1m\nle chat et la souris"},
        ],
    )
    lines(
        root / "twitter",
        [
            {"stock": "GME", "seq": 1, "created_utc": epoch("2024-01-02 11:00:00"), "raw": "u1\n@u\n.\n2h\nthe user is known"},
            {"stock": "GME", "seq": 2, "created_utc": epoch("2024-01-02 11:00:00"), "raw": "u9\n@u\n.\n2h\nthis is bad\nand the end"},
        ],
    )
    text(root / "positions", "stock,held\nGME,long\n")
    news = ("2024-01-02 10:00:00", "2024-01-02 12:00:00", "2024-01-03 09:00:00", "2024-01-03 10:00:00")
    record = {"category": "c", "image": "", "related": "T", "source": "s", "summary": "", "url": ""}
    lines(
        root / "news" / "ticker=T",
        [
            {**record, "id": i, "datetime": epoch(when), "headline": f"the good news of {'x' * i} is on"}
            for i, when in enumerate(news)
        ],
    )
    header = "ticker,date,open,high,low,close,adj_close,volume,dividend,split\n"
    days = [f"T,2024-01-0{d},1,1,1,1,{p},1,0,1" for d, p in ((2, 10), (3, 11), (4, 22))]
    text(root / "prices", header + "\n".join(days))
    text(root / "lexicon", "token,valence\ngood,2.0\n")
    return root


@pytest.fixture
def load_model():
    return lambda: lambda texts: [[t.count("bad") * 9.0, 0.0, t.count("good") * 9.0] for t in texts]


def test_social(spark, landing, tmp_path, load_model):
    out = tmp_path / "out"
    now = run.F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")
    run.run_social(spark, str(landing), str(out), now, load_model)
    rows = {r["stock"]: r for r in run.sinks.read_metrics_csv(spark, str(out / "metrics")).collect()}
    # TINY is too small; LATE comes after the screen has started over
    assert set(rows) == {"TSLA", "GME"}
    assert (rows["TSLA"]["nb_reddit"], rows["TSLA"]["nb_stocktwit"], rows["TSLA"]["total_nb"]) == (1, 0, 1)
    assert (rows["GME"]["nb_stocktwit"], rows["GME"]["nb_twitter"]) == (1, 1)
    assert rows["GME"]["avg_stocktwit"] > 0.9 and rows["GME"]["avg_twitter"] < -0.9
    signals = {r["stock"]: r["signal"] for r in spark.read.csv(str(out / "signals"), header=True).collect()}
    assert signals == {"TSLA": "none", "GME": "exit"}


def test_long_pages_and_navigation(spark, landing):
    """A page of 30 stocks behind a navigation table loses none; the repeat on the next page ends the list."""
    row = "<tr valign='top'><td>{}</td><td>{}</td><td>{}</td></tr>"
    menu = "<table><tr><td>1</td><td>NEWS</td><td>Menu</td></tr></table>"
    names = [[f"S{n}" for n in range(30)], ["T0", "S4", "T1"]]
    pages = [
        {"page": k, "html": menu + row.format("No.", "Ticker", "Company") + "".join(row.format(n, s, "Co") for n, s in enumerate(listed))}
        for k, listed in enumerate(names)
    ]
    lines(landing / "screener", pages)
    page = "<table><tr><td>x</td><td>y</td></tr></table><table class='W(100%) Bdcl(c)'><tr><td>Market Cap</td><td>{}</td></tr></table>"
    caps = [{"symbol": s, "html": page.format("3T")} for s in [*names[0], "T0", "T1", "NEWS", "Ticker"]]
    lines(landing / "caps", [*caps, {"symbol": "TSLA", "cap_text": "1T"}])
    found = {r["stock"] for r in run.followed_stocks(spark, str(landing)).collect()}
    assert found == {*names[0], "T0", "TSLA"}
    found = {r["stock"] for r in run.followed_stocks(spark, str(landing), trending_limit=0, minimum_cap=2e12).collect()}
    assert found == {*names[0], "T0"}


def test_comments_are_capped_on_request_only(spark, landing, tmp_path, load_model):
    rows = [{"id": i, "created_utc": epoch("2024-01-02 11:00:00") + i, "body": f"TSLA good {i}"} for i in range(20)]
    lines(landing / "comments", rows)
    now = run.F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")
    for limit, expected in ((None, 20), (7, 7)):
        out = tmp_path / f"out{limit}"
        run.run_social(spark, str(landing), str(out), now, load_model, comment_limit=limit)
        rows = {r["stock"]: r["nb_reddit"] for r in run.sinks.read_metrics_csv(spark, str(out / "metrics")).collect()}
        assert rows["TSLA"] == expected


def test_holiday_stops_the_run(spark, landing, tmp_path, load_model):
    now = run.F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    with pytest.raises(run.MarketClosed):
        run.run_social(spark, str(landing), str(tmp_path / "out"), now, load_model)


def test_news(spark, landing, tmp_path):
    out = tmp_path / "out"
    dates = [run.F.lit(d).cast("date") for d in ("2024-01-02", "2024-01-04")]
    run.run_news(spark, str(landing), str(out), *dates, minimum=2)
    rows = spark.read.parquet(str(out / "returns")).orderBy("date").collect()
    assert [r["daily_return"] and round(r["daily_return"], 6) for r in rows] == [None, 0.1, 1.0]
    score = round(2 / 19**0.5, 6)
    assert [r["sentiment"] and round(r["sentiment"], 6) for r in rows] == [None, score, None]


def test_command_line(spark, landing, tmp_path):
    out = tmp_path / "out"
    run.main(["news", str(landing), str(out), "--start", "2024-01-02", "--end", "2024-01-04", "--min-headlines", "2"])
    assert spark.read.parquet(str(out / "returns")).where("sentiment is not null").count() == 1
    assert spark.read.parquet(str(out / "correlation")).count() == 1
    bins = spark.read.parquet(str(out / "histogram")).collect()
    assert len(bins) == 50 and sum(r["n"] for r in bins) == 1


def test_social_command_line(spark, landing, tmp_path, monkeypatch, load_model):
    monkeypatch.setattr(run, "load_object", lambda name: load_model)
    out = tmp_path / "out"
    options = ["--lookback-other", "2", "--min-comments", "0", "--entry", "0.1", "--hold", "0.05", "--min-cap", "1e6"]
    run.main(["social", str(landing), str(out), "--now", "2024-01-02 12:00:00", "--model", "m:f", *options])
    rows = {r["stock"]: r for r in run.sinks.read_metrics_csv(spark, str(out / "metrics")).collect()}
    assert "TINY" in rows and rows["GME"]["nb_stocktwit"] == 0  # a smaller cap will do; its posts are a day old
    signals = {r["stock"]: r["signal"] for r in spark.read.csv(str(out / "signals"), header=True).collect()}
    assert signals["TSLA"] == "long"
