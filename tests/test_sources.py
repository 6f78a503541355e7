import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import close_to, day, pandas_sorted
from volpanel.functions import text as X
from volpanel.operators import text as T
from volpanel.operators.keep import last_applied, read_table, upsert_table
from volpanel.sources import documents as docs
from volpanel.sources import exchange
from volpanel.streaming import landed as stream
from volpanel.plans.ingest import ingest
from volpanel.session import scratch_path
from volpanel.workload import landed as workload


def land(folder, **files):
    for name, body in files.items():
        (folder / name.replace("__", ".")).write_text(body if isinstance(body, str) else json.dumps(body), encoding="utf-8")
    return str(folder)


def utc(c):
    return F.col(c).cast("timestamp_ntz")


def test_official_rate(spark, tmp_path):
    points = [{"data": "02/01/2024", "valor": "4.8520"}, {"data": "03/01/2024", "valor": "4.9010"}, {"data": "03/01/2024", "valor": "4.9010"}]
    raw = docs.read_documents(spark, land(tmp_path, venda__json=points)).withColumn("tipo", F.regexp_extract("path", r"([a-z]+)\.json", 1))
    out = pandas_sorted(docs.official_rate(raw), "date")
    assert out.values.tolist() == [[day("2024-01-02"), 4.852, "venda"], [day("2024-01-03"), 4.901, "venda"]]


def test_malformed_document_fails(spark, tmp_path):
    raw = docs.read_documents(spark, land(tmp_path, x__json="[{")).withColumn("tipo", F.lit("x"))
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        docs.official_rate(raw).collect()


def test_timelines(spark, tmp_path):
    body = {"timeline": [{"series": "Volume", "data": [{"date": "20240102T000000Z", "value": 3, "norm": 100000}, {"date": "20240103T000000Z", "value": 6, "norm": 120000}]}]}
    raw = docs.read_documents(spark, land(tmp_path, a__json=body, b__json={})).withColumn("query", F.lit("q"))
    out = pandas_sorted(docs.news_volume(raw), "date")
    close_to(out.share_pct, [0.003, 0.005])
    assert out.article_count.tolist() == [3, 6] and docs.news_volume(raw).columns == ["date", "article_count", "total_monitored", "share_pct", "query"]
    tone = docs.news_tone(raw).withColumn("local", X.local_day(F.col("date")))
    assert sorted(r.local for r in tone.collect()) == [day("2024-01-01"), day("2024-01-02")]


def test_headlines_keep_the_latest_per_address(spark, tmp_path):
    item = lambda url, when, title: {"url": url, "url_mobile": "", "title": title, "seendate": when, "domain": "d", "language": "Portuguese", "sourcecountry": "Brazil"}
    body = {"articles": [item("u1", "20240102T000000Z", "old"), item("u1", "20240103T000000Z", "new"), item("u2", "20240101T000000Z", "x")]}
    raw = docs.read_documents(spark, land(tmp_path, a__json=body)).withColumn("query", F.lit("q"))
    out = {r.url: r.title for r in docs.headlines(raw).collect()}
    assert out == {"u1": "new", "u2": "x"}


def test_meeting_documents(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    land(a, one__json={"conteudo": [{"nroReuniao": 260, "dataReferencia": "2024-01-31", "titulo": "t", "textoAta": "<p>Infla&ccedil;&atilde;o&nbsp; alta</p>\n<b>x</b>"}]})
    land(b, one__json={"conteudo": [{"nro_reuniao": 260, "dataReferencia": "2024-01-31T00:00:00", "titulo": "c", "textoComunicado": "a &amp;lt; b"}]})
    minutes, statements = docs.read_documents(spark, str(a)), docs.read_documents(spark, str(b))
    out = pandas_sorted(docs.meeting_documents(minutes, statements), "tipo")
    assert out.texto.tolist() == ["Inflação alta x", "a &lt; b"] and out.url_pdf.isna().all()
    assert out.data_referencia.tolist() == [day("2024-01-31")] * 2
    assert [r.nro_reuniao for r in docs.meeting_numbers(minutes.unionByName(statements)).collect()] == [260]


def test_survey_targets_activity(spark, tmp_path):
    row = lambda d, s, b, m: {"Data": d, "Suavizada": s, "Media": m, "Mediana": 4.0, "DesvioPadrao": 0.3, "numeroRespondentes": 100, "baseCalculo": b}
    value = [row("2024-01-02", "N", 0, 4.1), row("2024-01-02", "S", 0, 9.0), row("2024-01-02", "N", 1, 9.0), row("2024-01-03", "N", 0, 4.2)]
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    out = pandas_sorted(docs.survey_expectations(docs.read_documents(spark, land(a, s__json={"value": value}))), "date")
    assert out.pi_expectation.tolist() == [4.1, 4.2]
    raw = docs.read_documents(spark, land(b, m__json=[{"data": "01/01/2023", "valor": "3.25"}, {"data": "01/01/2024", "valor": "3.00"}]))
    assert sorted(map(tuple, docs.yearly_targets(raw).collect())) == [(2023, 3.25), (2024, 3.0)]
    got = pandas_sorted(docs.activity_index(raw), "reference_date")
    assert got.release_date[0] == day("2023-03-02")


REPORT = """<PricRpt><TradDt><Dt>2024-01-02</Dt></TradDt><SctyId><TckrSymb>{t}</TckrSymb></SctyId><FinInstrmAttrbts>{s}
<FrstPric Ccy="BRL">5001.5</FrstPric><LastPric Ccy="BRL">5002</LastPric><MinPric Ccy="BRL">4990</MinPric><MaxPric Ccy="BRL">5010</MaxPric>
<OpnIntrst>10</OpnIntrst><TradQty>7</TradQty></FinInstrmAttrbts></PricRpt>"""


def test_price_reports(spark, tmp_path):
    settle = lambda v: f'<AdjstdQt Ccy="BRL">{v}</AdjstdQt>'
    early = "<D>" + REPORT.format(t="DOLU26", s=settle(1)) + "</D>"
    late = "<D>" + "".join(REPORT.format(t=t, s=s) for t, s in (("DOLU26", settle(5000)), ("DOLU26C005600", settle(5)), ("DOLV26", ""), ("WDOU26", settle(5)))) + "</D>"
    path = land(tmp_path, PR_1__xml=early, PR_2__xml=late)
    want = [(day("2024-01-02"), "DOLU26", 5000.0, 5001.5, 5002.0, 4990.0, 5010.0, 10.0, 7.0)]
    assert list(map(tuple, exchange.futures_contracts(exchange.read_price_reports(spark, path)).collect())) == want
    texts = spark.createDataFrame([(early, "1"), (late, "2")], "doc string, snapshot string")
    assert list(map(tuple, exchange.futures_contracts(exchange.parse_price_reports(texts)).collect())) == want


def test_only_the_last_snapshot_of_a_package_is_opened(spark, tmp_path):
    settle = lambda v: f'<AdjstdQt Ccy="BRL">{v}</AdjstdQt>'
    for number, date in enumerate(("2024-01-02", "2024-01-03", "2024-01-04")):
        folder = tmp_path / date.replace("-", "")
        folder.mkdir()
        text = lambda v: "<D>" + REPORT.replace("2024-01-02", date).format(t="DOLU26", s=settle(v)) + "</D>"  # noqa: E731, B023
        land(folder, PR_1__xml="<D><PricRpt><TradDt><Dt>early</Dt></TradDt></PricRpt></D>", PR_2__xml=text(1), PR_3__xml=text(5000 + number))
    reports = exchange.read_price_reports(spark, str(tmp_path))
    opened = sorted(f.rsplit("/", 2)[1:] for f in reports.inputFiles())
    assert opened == [["20240102", "PR_3.xml"], ["20240103", "PR_3.xml"], ["20240104", "PR_3.xml"]]
    out = pandas_sorted(exchange.futures_contracts(reports), "date")
    assert out.settlement.tolist() == [5000.0, 5001.0, 5002.0]
    counted = exchange.newest_snapshots(spark, str(tmp_path), F.lit("all")).collect()
    assert [(r.snapshots, r.path.rsplit("/", 2)[1:]) for r in counted] == [(9, ["20240104", "PR_3.xml"])]
    with pytest.raises(Exception, match="PR_1.xml"):
        exchange.read_price_reports(spark, str(tmp_path), every=True).collect()
    (tmp_path / "none").mkdir()
    assert exchange.futures_contracts(exchange.read_price_reports(spark, str(tmp_path / "none"))).count() == 0


def test_broken_feed_is_an_error(spark, tmp_path):
    broken = "<rss><channel><item><title>a</title><link>l</item></channel></rss>"
    with pytest.raises(Exception, match="f.xml"):
        exchange.read_rss(spark, land(tmp_path, f__xml=broken)).collect()


def test_rss(spark, tmp_path):
    feed = """<rss version="2.0"><channel><item><title> A </title><link>l1</link><pubDate>Tue, 02 Jan 2024 22:30:00 -0300</pubDate>
    <description><![CDATA[<p>x &amp; y</p>]]></description></item><item><link>l2</link></item></channel></rss>"""
    items = exchange.read_rss(spark, land(tmp_path, f__xml=feed)).withColumn("source", F.lit("s"))
    out = pandas_sorted(exchange.rss_items(items).withColumn("date", utc("date")), "link")
    assert out.title.tolist() == ["A", ""] and out.description.tolist() == ["x & y", ""]
    assert str(out.date[0]) == "2024-01-03 01:30:00" and out.date.isna()[1]


def test_bundled_documents_land_in_few_files_and_read_the_same(spark, tmp_path):
    item = lambda i: {"url": f"u{i}", "title": f"t\n{i}", "seendate": f"202401{i % 28 + 1:02d}T000000Z", "domain": "d", "language": "pt", "sourcecountry": "BR"}
    bodies = [json.dumps({"articles": [item(i), item(i + 1)]}, indent=1) for i in range(400)]
    (tmp_path / "one" / "query=q").mkdir(parents=True)
    for i, body in enumerate(bodies):
        land(tmp_path / "one" / "query=q", **{f"d{i}__json": body})
    both = workload.land(spark.createDataFrame([(b, "q") for b in bodies], "doc string, query string"), str(tmp_path / "both"), "query")
    assert len(list((tmp_path / "both").rglob("part-*"))) <= 8
    tables = [ingest(spark, "headlines", p, str(tmp_path / f"t{b}"), b) for p, b in ((str(tmp_path / "one"), False), (both, True))]
    one, bundled = (sorted(map(tuple, t.collect())) for t in tables)
    assert one == bundled and len(one) == 401 and one[0][1] == "t\n0"
    feeds = ["<rss><channel><item><title>a</title><link>1</link></item><item><link>2</link></item></channel></rss>", "<rss><channel/></rss>", "<rss><channel>\n<item><link> 3</link></item></channel></rss>"]
    path = workload.land(spark.createDataFrame([(f, "s") for f in feeds], "doc string, source string").coalesce(1), str(tmp_path / "rss"), "source")
    got = exchange.rss_items(exchange.read_rss(spark, path, bundled=True)).collect()
    assert sorted((r.title, r.link, r.source) for r in got) == [("", "2", "s"), ("", "3", "s"), ("a", "1", "s")]
    (tmp_path / "bad").mkdir()
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        exchange.read_rss(spark, land(tmp_path / "bad", f__xml="<rss><channel><item><title>a</title><link>l</item></channel></rss>"), bundled=True).collect()


def test_bars_pairs_and_series(spark, tmp_path):
    raw = spark.createDataFrame([("2024-01-02", 1, 2.0, 0.5, 1.5), ("2024-01-02", 1, 2.0, 0.5, 1.5)], "Date string, Open int, High double, Low double, Close double")
    assert list(map(tuple, exchange.daily_bars(raw).collect())) == [(day("2024-01-02"), 1.0, 2.0, 0.5, 1.5)]
    long = spark.createDataFrame([("2024-01-02", "V", 13.0), ("2024-01-02", "D", 102.0), ("2024-01-03", "V", float("nan")), ("2024-01-04", "X", 1.0)], "date string, ticker string, close double")
    out = exchange.paired_closes(long, {"vix": "V", "dxy": "D"}).collect()
    assert [(r.vix_close, r.dxy_close) for r in out] == [(13.0, 102.0)]
    path = str(tmp_path / "t")
    exchange.write_table(spark.createDataFrame([("venda", "2024-01-02", 5.0), ("compra", "2024-01-02", 4.0)], "tipo string, date string, value double"), path, ("tipo",))
    assert [tuple(r) for r in exchange.read_series(spark, path, "value", {"tipo": "venda"}).collect()] == [("2024-01-02", 5.0)]
    with pytest.raises(PySparkException):
        exchange.read_series(spark, str(tmp_path / "missing"), "value")
    fut = str(tmp_path / "f")
    spark.createDataFrame([("2024-01-02", 5000.0, 5010.0, 4990.0, False)], "date string, settlement double, high double, low double, contract_changed boolean").write.parquet(fut)
    assert exchange.read_futures_prices(spark, fut).collect()[0].close == 5.0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    exchange.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["a", "b"]
    exchange.write_json(df, str(tmp_path / "j"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert '{"a":1,"b":null}' in lines


def test_dates_and_chunks(spark):
    df = spark.createDataFrame([("02/01/2024", "2024-01-01", "2024-01-20")], "d string, a string, b string")
    r = df.select(X.day_first(F.col("d")).alias("d"), X.date_chunks(F.to_date("a"), F.to_date("b"), 7).alias("c"), X.short_hash(F.lit("q")).alias("h")).collect()[0]
    assert r.d == day("2024-01-02") and [(c.chunk_start.day, c.chunk_end.day) for c in r.c] == [(1, 8), (9, 16), (17, 20)]
    assert len(r.h) == 10
    assert exchange.weekdays(spark.createDataFrame([("2024-01-05",), ("2024-01-06",)], "date string")).count() == 1


def test_text_scores_and_daily_index(spark):
    table = {"bom": ("POSITIVE", 0.9), "ruim": ("NEGATIVE", 0.8)}

    def make_scorer():
        return lambda texts: [dict(zip(("label", "score"), table.get(t, ("NEUTRAL", 0.5)))) for t in texts]

    rows = [("2024-01-02", "bom"), ("2024-01-02", "ruim"), ("2024-01-03", "outro"), (None, "bom")]
    df = spark.createDataFrame(rows, "date string, text string")
    out = pandas_sorted(T.daily_index(T.model_scores(df, "text", make_scorer, 2)), "date")
    close_to(out.sentiment_mean, [0.05, 0.0])
    close_to(out.share_negative, [0.5, 0.0])
    assert out.n_texts.tolist() == [2, 1]
    assert T.daily_index(T.model_scores(df.limit(0), "text", make_scorer)).count() == 0
    lex = T.lexicon_scores(df.withColumn("text", F.lit("Bom, bom; ruim")), "text", ["bom"], ["ruim"]).collect()[0]
    assert lex.label == "POSITIVE" and abs(lex.signed_score - 1 / 3) < 1e-12


def test_headline_selection_and_corpus(spark):
    rows = [("2024-01-02", "a", "Portuguese", "q"), ("2024-01-02", "b", "English", "q"), ("2024-01-02", "c", "Portuguese", "z")]
    h = spark.createDataFrame(rows, "date string, title string, language string, query string")
    assert [r.title for r in T.select_headlines(h, "q").collect()] == ["a"]
    with pytest.raises(ValueError):
        T.select_headlines(h, "q", "French", require=True)
    docs_ = spark.createDataFrame([("2024-01-01", "ata")], "data_referencia string, texto string")
    assert sorted(r.text for r in T.combined_corpus(docs_, h).collect()) == ["a", "ata", "b", "c"]
    with pytest.raises(FileNotFoundError):
        T.combined_corpus()


def write_batch(spark, folder, rows):
    spark.createDataFrame(rows, "k string, ts string, label string, v double").coalesce(1).write.mode("append").json(folder)


def test_streams_merge_batches_and_late_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = spark.createDataFrame([], "k string, ts timestamp, label string, v double").schema
    source = lambda: stream.landed_files(spark, folder, schema, "json", 1)
    latest, share, once = (scratch_path(spark, n) for n in ("latest", "share", "once"))
    batches = [
        [("a", "2024-01-01T10:00:00Z", "x", 1.0), ("b", "2024-01-01T11:00:00Z", "y", 2.0)],
        [("a", "2024-01-02T10:00:00Z", "x", 3.0)],
        [("c", "2024-01-01T12:00:00Z", "x", 4.0)],
    ]
    for rows in batches:
        write_batch(spark, folder, rows)
        day_of = lambda b: b.withColumn("date", F.to_date("ts"))
        stream.finish(stream.upsert_stream(source(), latest, latest + "-c", ["k"], parse=day_of))
        stream.finish(stream.daily_share_stream(source(), share, share + "-c", "ts", F.col("label") == "x"))
        stream.finish(stream.append_stream(stream.first_arrivals(source(), ["k"], "ts"), once, once + "-c"))
    assert {r.k: r.v for r in read_table(spark, latest).collect()} == {"a": 3.0, "b": 2.0, "c": 4.0}
    got = pandas_sorted(read_table(spark, share), "date")
    assert got.hits.tolist() == [2, 1] and got.total.tolist() == [3, 1]
    assert sorted(r.k for r in spark.read.parquet(once).collect()) == ["a", "b", "c"]


def test_equal_texts_are_scored_once_in_batches_of_like_length(spark, tmp_path):
    log = str(tmp_path / "asked")

    def make_scorer():
        def score(texts):
            with open(log, "a", encoding="utf-8") as out:
                out.write(json.dumps([len(t.split()) for t in texts]) + "\n")
            return [{"label": "POSITIVE", "score": len(t) / 100} for t in texts]

        return score

    texts = ["word " * n for n in (1, 2, 3, 600, 601, 5)] + [None, "same", "same"] + ["often"] * 200
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "k int, t string, digest int").coalesce(1)
    out = T.model_scores(df, "t", make_scorer, batch=4, window=512, budget=1024)
    assert out.columns == ["k", "t", "digest", "label", "score", "signed_score"]
    got = {r.k: r.signed_score for r in out.collect()}
    assert got == {i: None if t is None else len(t) / 100 for i, t in enumerate(texts)}
    asked = [json.loads(line) for line in open(log, encoding="utf-8")]
    assert sorted(n for b in asked for n in b) == [1, 1, 1, 2, 3, 5, 600, 601]
    assert all(len(b) <= 4 and (len(b) == 1 or len(b) * min(max(b), 512) <= 1024) for b in asked)


def test_a_worker_holds_a_thousand_texts_at_most(spark):
    def make_scorer():
        return lambda texts: [{"label": "POSITIVE", "score": float(len(texts))} for _ in texts]

    df = spark.range(2500).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("t")).coalesce(1)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        sizes = [r.score for r in T.score_once(df, "t", make_scorer, batch=5000, budget=10**6).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len(sizes) == 2500 and max(sizes) <= 1000


def test_batches_are_cut_by_tokens():
    assert T.cut_batches([], 10, 4) == []
    assert T.cut_batches([9, 1, 1, 3, 50, 1, 1], 10, 4) == [[1, 2, 5, 6], [3], [0], [4]]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """The last batch again, an older one after a newer one, and the first batch of another stream."""
    table = scratch_path(spark, "replayed")
    rows = lambda v: spark.createDataFrame([("a", day("2024-01-01"), v)], "k string, date date, v double")
    merge = lambda b: upsert_table(b.withColumn("_part", F.lit(0)), table, ["k"], "date", "last", ["_part"])
    each, other = stream.merged_once(table, "mark", merge), stream.merged_once(table, "other", merge)
    value = lambda: [r.v for r in read_table(spark, table).collect()]
    seen = []
    for number, v in ((0, 1.0), (1, 2.0), (0, 1.0), (1, 9.0), (2, 3.0), (1, 2.0)):
        each(rows(v), number)
        seen += value()
    assert seen == [1.0, 2.0, 2.0, 2.0, 3.0, 3.0]
    other(rows(7.0), 0)
    assert value() == [7.0]
    each(rows(8.0), 2)
    assert value() == [7.0] and last_applied(spark, table, "none") == -1


def test_daily_index_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01T10:00:00Z", "NEGATIVE", -0.5), ("2024-01-01T11:00:00Z", "POSITIVE", 1.0)], "ts string, label string, signed_score double").write.json(folder)
    schema = spark.createDataFrame([], "ts timestamp, label string, signed_score double").schema
    table = scratch_path(spark, "mood")
    stream.finish(stream.daily_index_stream(stream.landed_files(spark, folder, schema, "json"), table, table + "-c", "ts"))
    r = read_table(spark, table).collect()[0]
    assert (r.sentiment_mean, r.share_negative, r.n_texts) == (0.25, 0.5, 2)
