import math

from pyspark.sql import functions as F

from parlance.operators import metrics as M, reports as R
from tests.conftest import rows

ALERT_DOC = "state string, features array<struct<properties:map<string,string>>>"


def test_alert_absent_vs_null(spark):
    docs = spark.createDataFrame([
        ("AA", [({"event": "Flood", "description": None},)]),
        ("BB", []), ("CC", None)], ALERT_DOC)
    req = spark.createDataFrame([("AA",), ("BB",), ("CC",), ("DD",)], "state string")
    got = dict(rows(R.alert_reports(req, docs), "state", "report"))
    i = " " * 8
    assert got["AA"] == (f"\n{i}Event: Flood\n{i}Area: Unknown\n{i}Severity: Unknown\n{i}Description: None\n"
                         f"{i}Instructions: No specific instructions provided\n{i}")
    assert got["BB"] == R.EMPTY_ALERTS and got["CC"] == R.NO_ALERTS_DOCUMENT and got["DD"] == R.NO_ALERTS_DOCUMENT


def test_forecast_lookup_and_first_five(spark):
    per = [(f"P{i}", 60 + i, "F", "5 mph", "N", "Sunny") for i in range(7)]
    req = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)], "latitude double, longitude double")
    pts = spark.createDataFrame([(1.0, 2.0, "g1"), (3.0, 4.0, "g2")], "latitude double, longitude double, forecast string")
    fc = spark.createDataFrame([("g1", per)], f"forecast string, periods array<{R.PERIOD_DDL}>")
    j = R.point_forecast_lookup(req, pts, fc)
    got = {(r.latitude): r.report for r in j.select("latitude", R.forecast_report(j).alias("report")).collect()}
    assert got[5.0] == R.NO_POINT and got[3.0] == R.NO_FORECAST
    parts = got[1.0].split(R.REPORT_SEPARATOR)
    assert len(parts) == 5 and parts[0] == "\n    P0:\n    Temperature: 60°F\n    Wind: 5 mph N\n    Forecast: Sunny\n    "


def _scores(spark, pairs):
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(pairs)], "idx long, p string, g string")
    return {r.idx: r for r in M.token_overlap(df, "idx", "p", "g").collect()}


def test_squad_scores_hand_worked(spark):
    s = _scores(spark, [("The cat sat.", "a cat sat"), ("cat cat dog", "cat dog dog"), ("", ""), ("x", "")])
    assert s[0].exact_match == 1 and s[0].f1 == 1.0
    assert s[1].common == 2 and math.isclose(s[1].f1, 2 / 3) and math.isclose(s[1].recall, 2 / 3)
    assert s[2].f1 == 1.0 and s[2].exact_match == 1
    assert s[3].f1 == 0.0 and s[3].precision == 0.0


def _bleu_ref(hyps, refs, order=4):
    from collections import Counter
    match, total = [0] * order, [0] * order
    sys_len = ref_len = 0
    for h, r in zip(hyps, refs):
        h, r = h.split(), r.split()
        sys_len += len(h)
        ref_len += len(r)
        for n in range(1, order + 1):
            hc = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
            rc = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
            match[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            total[n - 1] += max(len(h) - n + 1, 0)
    precs, k = [], 0
    for n in range(order):
        if total[n] == 0:
            break
        if match[n] == 0:
            k += 1
            precs.append(100.0 / (2 ** k * total[n]))
        else:
            precs.append(100.0 * match[n] / total[n])
    bp = 1.0 if sys_len >= ref_len else math.exp(1 - ref_len / sys_len)
    return bp * math.exp(sum(math.log(p) for p in precs) / len(precs))


def test_corpus_bleu_matches_python(spark):
    hyps = ["the cat sat on the mat", "a b c d e", "hello world"]
    refs = ["the cat sat on a mat today", "a b c d e", "hello there world"]
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(zip(hyps, refs))], "idx long, p string, g string")
    got = M.corpus_bleu(df, "idx", "p", "g").first().bleu
    assert math.isclose(got, _bleu_ref(hyps, refs), rel_tol=1e-9)


def test_corpus_chrf_identical_is_100(spark):
    df = spark.createDataFrame([(0, "abc def", "abcdef"), (1, "xyz", "xyz")], "idx long, p string, g string")
    r = M.corpus_chrf(df, "idx", "p", "g").first()
    assert math.isclose(r.chrf, 100.0)


def test_gram_sums_equal_counters(spark, monkeypatch):
    import random
    from collections import Counter
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abé😀") for _ in range(rnd.randrange(1, 3)))
    text = lambda: " ".join(word() for _ in range(rnd.choice([0, 1, 2, 5, 40])))
    data = [(i, text(), text()) for i in range(50)] + [(50, None, "a b"), (51, "a b", None), (52, "", "")]
    df = spark.createDataFrame(data, "idx long, p string, g string").repartition(3)

    def want(sym, order):
        out = []
        for n in range(1, order + 1):
            c = [[Counter(tuple(s[i:i + n]) for i in range(len(s) - n + 1)) for s in (sym(p or ""), sym(g or ""))] for _, p, g in data]
            out += [sum(sum(a.values()) for a, _ in c), sum(sum(b.values()) for _, b in c), sum(sum((a & b).values()) for a, b in c)]
        return out
    for limit in (1 << 20, 7):
        monkeypatch.setattr(M, "_TOGETHER", limit)
        w = M._order_sums(df.select(M.ws_tokens("p").alias("_p"), M.ws_tokens("g").alias("_g")), 4, True).first()
        assert list(w)[2:] == want(str.split, 4) and (w.sys_len, w.ref_len) == (w.hyp1, w.ref1)
        c = M._order_sums(df.select(F.col("p").alias("_p"), F.col("g").alias("_g")), 6, False).first()
        assert list(c)[2:] == want(list, 6)


def test_matches_equal_counters(spark):
    import random
    from collections import Counter
    rnd = random.Random(4)
    data = [(i, [rnd.choice("abcdé😀") for _ in range(rnd.randrange(12))], [rnd.choice("abce😀") for _ in range(rnd.randrange(12))])
            for i in range(60)] + [(60, [], []), (61, ["x"] * 500, ["x"] * 300 + ["y"])]
    df = spark.createDataFrame(data, "i long, p array<string>, g array<string>")
    got = dict(rows(df.select("i", M.matches("p", "g").alias("m")), "i", "m"))
    assert got == {i: sum((Counter(p) & Counter(g)).values()) for i, p, g in data}


def test_metric_plans_send_no_grams(spark):
    df = spark.createDataFrame([(1, "a b c a", "a c b"), (2, "", "x")], "idx long, p string, g string")
    for out in (M.token_overlap(df, "idx", "p", "g"), M.corpus_bleu(df, "idx", "p", "g"), M.corpus_chrf(df, "idx", "p", "g")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan


def test_bleu_without_matches_or_orders_is_zero(spark):
    from parlance.operators import metrics as M
    none = spark.createDataFrame([(1, "a b c d e", "v w x y z")], "idx long, p string, g string")
    assert M.corpus_bleu(none, "idx", "p", "g").first().bleu == 0.0
    short = spark.createDataFrame([(1, "a b", "a b")], "idx long, p string, g string")
    assert M.corpus_bleu(short, "idx", "p", "g").first().bleu == 0.0
    same = spark.createDataFrame([(1, "a b c d e", "a b c d e")], "idx long, p string, g string")
    assert abs(M.corpus_bleu(same, "idx", "p", "g").first().bleu - 100.0) < 1e-9


def test_null_fields_read_none(spark):
    from pyspark.sql import functions as F

    from parlance.operators import reports, tools
    p = spark.sql("select named_struct('name', 'Now', 'temperature', cast(null as int), 'temperatureUnit', 'F', 'windSpeed', '5', "
                  "'windDirection', 'N', 'detailedForecast', 'x') as p")
    assert "Temperature: None" in p.select(reports.format_period(F.col("p"))).first()[0]
    b = spark.createDataFrame([([("tool_use", None, "t", None, "after")],)],
                              "b array<struct<type:string,text:string,name:string,input:string,follow_up:string>>")
    assert b.select(tools.flatten_blocks("b")).first()[0] == "[Calling tool t with args None]\nafter"


def test_long_form_equals_nested_form(spark):
    prop = lambda i: {"event": f"e{i}"} if i % 3 else {"event": None, "severity": "x"}
    feats = [(k, 10 * i, prop(i)) for k, n in (("a", 300), ("b", 2), ("c", 0)) for i in range(n)]
    f = spark.createDataFrame(feats[::-1], "state string, seq long, properties map<string,string>")
    d = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False)], "state string, has_features boolean")
    req = spark.createDataFrame([(x,) for x in "abcde"], "state string")
    nested = spark.createDataFrame(
        [(k, None if k == "d" else [{"properties": p} for q, _, p in feats if q == k]) for k in "abcd"],
        "state string, features array<struct<properties:map<string,string>>>")
    want = rows(R.alert_reports(req, nested), "state", "report")
    got = R.alert_reports_long(req, d, f)
    assert rows(got, "state", "report") == want
    num = rows(R.numbered_alerts(f), "state", "pos", "alert")
    ex = nested.select("state", F.posexplode("features").alias("pos", "f"))
    assert num == rows(ex.select("state", "pos", R.format_alert(F.col("f.properties")).alias("alert")))


def test_forecast_rows_are_limited_before_the_list(spark):
    p = spark.createDataFrame([("g", i, f"n{i}") for i in range(50, 0, -1)] + [("h", 1, None)], "forecast string, t long, name string")
    shown = R.shown_periods(p, ["t"], F.coalesce("name", F.lit("-")), ",")
    assert rows(shown) == [("g", "n1,n2,n3,n4,n5"), ("h", "-")]
    assert "WindowGroupLimit" in shown._jdf.queryExecution().executedPlan().toString()
    req = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)], "latitude double, longitude double")
    pts = spark.createDataFrame([(1.0, 2.0, "g"), (3.0, 4.0, "none")], "latitude double, longitude double, forecast string")
    j = R.point_forecast_counts(req, pts, R.period_counts(p))
    assert rows(j, "latitude", "lookup_status", "n_periods") == [(1.0, "ok", 50), (3.0, "no_forecast", None), (5.0, "no_point", None)]
