"""DuckDB statements with the same results as the registered queries.

Each statement is composed of named common table expressions. Where SQL has no operator for the job the
oracle takes another road than the Spark code: regressions by successive orthogonalisation, non-overlapping
trades and spikes by recursion row by row, the one-sided trend by recursion over its covariance.
"""

from __future__ import annotations

import re
from statistics import NormalDist

from volpanel.operators.garch import LEAST_ROWS, MOST_PERSISTENCE
from volpanel.functions.normal import HART_DENOMINATOR, HART_NUMERATOR, HART_SWITCH, HART_TAIL, SQRT_2PI
from volpanel.functions.small_stats import EULER_MASCHERONI
from volpanel.operators.trend import MONTHLY_LAMBDA
from volpanel.workload.queries import DIGITS, GARCH_PARAMETERS
from volpanel.workload.tables import BAD_WORDS, DELTAS, FIRST_DAY, GOOD_WORDS, HEADLINE_DAYS, TENORS

H = 21


def r(expr: str, name: str | None = None) -> str:
    name = name or expr
    return f"round({expr}, {DIGITS.get(name, 6)}) + 0.0 AS {name}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def words(lex: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in lex)


def cdf(x: str) -> str:
    """Normal distribution of a column as SQL text, same coefficients as the Column form."""

    def horner(cs):
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out} * abs({x}) + {c!r})"
        return out

    tail = f"(abs({x}) + {HART_TAIL})"
    for k in (4, 3, 2, 1):
        tail = f"(abs({x}) + {k}.0 / {tail})"
    e = f"exp(-{x} * {x} / 2)"
    low = f"(CASE WHEN abs({x}) < {HART_SWITCH} THEN {e} * {horner(HART_NUMERATOR)} / {horner(HART_DENOMINATOR)} ELSE {e} / {tail} / {SQRT_2PI!r} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {low} ELSE {low} END)"


def rows(n: int, ahead: int | None = None, keys: str = "series_id", time: str = "date") -> str:
    frame = f"{n - 1} PRECEDING AND CURRENT ROW" if ahead is None else f"1 FOLLOWING AND {ahead} FOLLOWING"
    part = f"PARTITION BY {keys} " if keys else ""
    return f"({part}ORDER BY {time} ROWS BETWEEN {frame})"


def mean(x: str, n: int, keys: str = "series_id", time: str = "date", minimum: int | None = None) -> str:
    w = rows(n, None, keys, time)
    return f"CASE WHEN count({x}) OVER {w} >= {minimum or n} THEN avg({x}) OVER {w} END"


def target(h: int) -> str:
    w = rows(0, h)
    return f"sqrt((CASE WHEN count(variance) OVER {w} >= {h} THEN avg(variance) OVER {w} END) * 252) * 100"


P = "(PARTITION BY series_id ORDER BY date)"

CTES: dict[str, str] = {
    "li": """SELECT l_returnflag || l_linestatus AS series_id, CAST(l_shipdate AS DATE) AS date,
        l_extendedprice / l_quantity / 99991 + 5 AS px,
        CAST(l_orderkey AS HUGEINT) * 100000000000000 + CAST(l_linenumber AS BIGINT) * 10000000000000
        + CAST(round(l_extendedprice * 100) AS BIGINT) * 1000 + CAST(l_quantity AS BIGINT) AS seq FROM lineitem""",
    "bars": """SELECT series_id, date, arg_min(px, seq) AS open, max(px) AS high, min(px) AS low,
        arg_max(px, seq) AS close, count(*) AS trades FROM li GROUP BY series_id, date""",
    "varied": "SELECT *, pow(ln(high / low), 2) / (4 * ln(2)) AS variance FROM bars",
    "prices": "SELECT series_id, date, avg(px) AS close FROM li GROUP BY series_id, date",
    "price_ret": f"SELECT *, ln(close) - lag(ln(close)) OVER {P} AS ret FROM prices",
    "har": f"""SELECT *, variance AS rv_d, {mean('variance', 5)} AS rv_w, {mean('variance', 22)} AS rv_m,
        {target(H)} AS target FROM varied""",
    "official": """SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 99991 AS value
        FROM orders GROUP BY ALL""",
    "risk": """SELECT date, max(CASE WHEN series_id = '1-URGENT' THEN value END) AS vix_close,
        max(CASE WHEN series_id = '5-LOW' THEN value END) AS dxy_close FROM official
        WHERE series_id IN ('1-URGENT', '5-LOW') GROUP BY date""",
    "risk_changes": """SELECT date, vix_close AS vix_level, vix_close - lag(vix_close) OVER (ORDER BY date) AS vix_change,
        ln(dxy_close) - lag(ln(dxy_close)) OVER (ORDER BY date) AS dxy_return FROM risk""",
    "attention": """SELECT CAST(o_orderdate AS DATE) AS date,
        count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*) * 100 AS share_pct FROM orders GROUP BY 1""",
    "surprised": f"""SELECT date, share_pct, (share_pct - {mean('share_pct', 63, '', 'date', 21)})
        / nullif(CASE WHEN count(share_pct) OVER {rows(63, None, '')} >= 21 AND min(share_pct) OVER {rows(63, None, '')}
        < max(share_pct) OVER {rows(63, None, '')} THEN stddev_samp(share_pct) OVER {rows(63, None, '')} END, 0) AS surprise
        FROM attention""",
    "headlines": f"""SELECT CAST(DATE '{FIRST_DAY}' + CAST(doc_id % {HEADLINE_DAYS} AS INTEGER) AS DATE) AS date, text AS title,
        lang AS language, source AS query, doc_id FROM documents""",
    "mood": "SELECT date, avg(signed_score) AS sentiment_mean FROM scored GROUP BY date",
    "news": f"SELECT date, {mean('sentiment_mean', 21, '', 'date', 1)} AS news FROM mood",
    "survey": """SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 99991 AS pi_expectation,
        stddev_samp(o_totalprice) / 99991 AS dispersion FROM orders GROUP BY 1""",
    "meta": """SELECT year(o_orderdate) AS year, avg(o_totalprice) / 99991 AS meta FROM orders GROUP BY 1""",
    "anchored": """SELECT s.date, pi_expectation - CASE WHEN year(date) = year(date + 365) THEN m0.meta ELSE
        (date_diff('day', date, make_date(year(date) + 1, 1, 1)) / 365.0) * m0.meta
        + (1 - date_diff('day', date, make_date(year(date) + 1, 1, 1)) / 365.0) * coalesce(m1.meta, m0.meta) END AS gap,
        dispersion, exp(-abs(gap) / 2.0) AS theta_baseline
        FROM survey s LEFT JOIN meta m0 ON m0.year = year(date) LEFT JOIN meta m1 ON m1.year = year(date + 365)""",
    "activity": """SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS reference_date,
        CAST(CAST(date_trunc('month', o_orderdate) AS DATE) + 60 AS DATE) AS release_date, CAST(count(*) AS DOUBLE) AS value
        FROM orders GROUP BY ALL""",
    "vol21": f"SELECT series_id, date, sqrt({mean('variance', 21)} * 252) * 100 AS range_vol_21 FROM varied",
    "surface": f"""SELECT series_id, refdate, CAST(refdate + t AS DATE) AS maturity_date, d AS delta_pct,
        level * (0.8 + t / 400 + abs(d - 50) / 500) AS iv_pct FROM (SELECT series_id,
        CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) AS refdate, avg(range_vol_21) AS level FROM vol21
        WHERE range_vol_21 IS NOT NULL GROUP BY ALL),
        (VALUES {', '.join(f'({t})' for t in TENORS)}) a(t), (VALUES {', '.join(f'(CAST({d} AS DOUBLE))' for d in DELTAS)}) b(d)""",
    "contracts": """SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS ticker, avg(px) AS settlement,
        CASE WHEN count(*) > 1 THEN min(px) END AS open, max(px) AS last, min(px) AS low, max(px) AS high,
        sum(l_quantity) AS open_interest, count(*) AS trades
        FROM (SELECT *, l_extendedprice / l_quantity / 99991 + 5 AS px FROM lineitem) JOIN part ON p_partkey = l_partkey
        GROUP BY ALL""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY date ORDER BY trades DESC, open_interest DESC, ticker DESC) AS k FROM contracts",
    "front_row": "SELECT * FROM ranked WHERE k = 1",
    "front_filled": """SELECT date, arg_min(ticker, k) AS ticker, arg_min(settlement, k) AS settlement,
        arg_min(open, k) FILTER (WHERE open IS NOT NULL) AS open, arg_min(last, k) AS last, arg_min(low, k) AS low,
        arg_min(high, k) AS high FROM ranked GROUP BY date""",
}

_LEX = f"""SELECT *, len(list_filter(w, lambda x: x IN ({words(GOOD_WORDS)}))) AS p,
    len(list_filter(w, lambda x: x IN ({words(BAD_WORDS)}))) AS n FROM (
    SELECT *, regexp_split_to_array(lower({{text}}), '[^\\p{{{{L}}}}]+') AS w FROM {{table}})"""


def lexicon(table: str, text: str) -> str:
    inner = _LEX.format(table=table, text=text).replace("{{", "{").replace("}}", "}")
    return f"""SELECT * EXCLUDE (w, p, n), CASE WHEN p > n THEN 'POSITIVE' WHEN n > p THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label,
        CASE WHEN p + n = 0 THEN 0.0 ELSE abs(p - n) / (p + n) END AS score,
        CASE WHEN p + n = 0 THEN 0.0 ELSE (p - n) / (p + n) END AS signed_score FROM ({inner})"""


CTES["scored"] = lexicon("headlines", "title")


def dataset(features: list[str], joins: str = "", extra: str = "", source: str = "har") -> str:
    """Numbered complete rows of a supervised dataset."""
    present = " AND ".join(f"{f} IS NOT NULL" for f in [*features, "target"])
    return f"""SELECT *, row_number() OVER {P} - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n
        FROM (SELECT b.*{extra} FROM {source} b {joins}) WHERE {present}"""


HAR = ["rv_d", "rv_w", "rv_m"]
CTES["extended"] = f"""SELECT *, pow(ln(open / lag(close) OVER {P}), 2) AS overnight,
    CASE WHEN ln(close) - lag(ln(close)) OVER {P} > 0 THEN variance ELSE 0.0 END AS rv_d_pos,
    CASE WHEN ln(close) - lag(ln(close)) OVER {P} < 0 THEN variance ELSE 0.0 END AS rv_d_neg FROM har"""
DATASETS = {
    "base": (HAR, dataset(HAR)),
    "news": (HAR + ["news"], dataset(HAR + ["news"], "ASOF LEFT JOIN news x ON b.date >= x.date", ", x.news")),
    "extended": (
        HAR + ["overnight", "rv_d_pos", "rv_d_neg"], dataset(HAR + ["overnight", "rv_d_pos", "rv_d_neg"], source="extended"),
    ),
    "global_risk": (
        HAR + ["vix_level", "vix_change", "dxy_return"],
        dataset(HAR + ["vix_level", "vix_change", "dxy_return"], "ASOF LEFT JOIN risk_changes x ON b.date >= x.date",
                ", x.vix_level, x.vix_change, x.dxy_return"),
    ),
    "credibility": (
        HAR + ["theta_baseline", "dispersion"],
        dataset(HAR + ["theta_baseline", "dispersion"], "ASOF LEFT JOIN anchored x ON b.date >= x.date",
                ", x.theta_baseline, x.dispersion"),
    ),
    "fiscal": (
        HAR + ["fiscal_surprise", "fiscal_sentiment"],
        dataset(HAR + ["fiscal_surprise", "fiscal_sentiment"],
                "ASOF LEFT JOIN surprised x ON b.date >= x.date ASOF LEFT JOIN mood5 y ON b.date >= y.date",
                ", x.surprise AS fiscal_surprise, y.fiscal_sentiment"),
    ),
    "attention_level": (HAR + ["news"], dataset(HAR + ["news"], "ASOF LEFT JOIN share21 x ON b.date >= x.date", ", x.news")),
    "attention_news": (HAR + ["news"], dataset(HAR + ["news"], "ASOF LEFT JOIN surprised x ON b.date >= x.date", ", x.surprise AS news")),
}
CTES["share21"] = f"SELECT date, {mean('share_pct', 21, '', 'date', 1)} AS news FROM attention"
CTES["mood5"] = f"SELECT date, {mean('sentiment_mean', 5, '', 'date', 1)} AS fiscal_sentiment FROM mood"
CTES |= {f"ds_{k}": v[1] for k, v in DATASETS.items()}

FOLDS = {
    "purged": "SELECT series_id, n, i AS fold, greatest(n // 6 * i - 26, 0) AS train_end, n // 6 * i AS test_start, least(n, n // 6 * (i + 1)) AS test_end FROM sizes, range(1, 6) t(i) WHERE n // 6 * i > 26",
    "expanding": "SELECT series_id, n, i AS fold, n // 6 * i AS train_end, n // 6 * i AS test_start, least(n, n // 6 * (i + 1)) AS test_end FROM sizes, range(1, 6) t(i)",
    "steps": "SELECT series_id, n, i AS fold, 252 + i * 21 - 26 AS train_end, 252 + i * 21 AS test_start, least(n, 252 + (i + 1) * 21) AS test_end FROM sizes, range(0, 100000) t(i) WHERE 252 + i * 21 < n",
    "single": "SELECT series_id, n, 1 AS fold, n - greatest(1, CAST(floor(n * 0.2) AS BIGINT)) AS train_end, n - greatest(1, CAST(floor(n * 0.2) AS BIGINT)) AS test_start, n AS test_end FROM sizes",
}


def folds(ds: str, scheme: str) -> dict[str, str]:
    return {
        "sizes": f"SELECT series_id, count(*) AS n FROM {ds} GROUP BY series_id",
        "folds": FOLDS[scheme],
    }


def regression(
    tag: str, ds: str, features: list[str], y: str, keep: str = "", keys: str = "series_id", folds_cte: str = "folds"
) -> dict[str, str]:
    """Least squares per fold by successive orthogonalisation of centred features.

    The last CTE, ``<tag>``, holds every row of the fold with ``fit`` (fitted y) and ``s_<f>`` of the last step,
    which is the coefficient of the last feature.
    """
    key_list = ", ".join(f"d.{k}" for k in keys.split(", "))
    match = " AND ".join(f"d.{k} = f.{k}" for k in keys.split(", "))
    w = f"OVER (PARTITION BY {keys}, fold)"
    scaled = ", ".join(f"{f} AS z{i}" for i, f in enumerate(features))
    usable = f"({y}) IS NOT NULL"
    out = {
        f"{tag}_r": f"""SELECT {key_list}, d.date, d.rn, d.target, d.rv_m AS rvm, {keep} f.fold, d.rn < f.train_end AND {usable} AS tr,
            d.rn >= f.test_start AND d.rn < f.test_end AS te, {y} AS y, {scaled} FROM {ds} d JOIN {folds_cte} f
            ON {match} WHERE d.rn < f.train_end OR (d.rn >= f.test_start AND d.rn < f.test_end)""",
    }
    zs = [f"z{i}" for i in range(len(features))]
    centred = ", ".join(f"{z} - avg({z}) FILTER (WHERE tr) {w} AS {z}" for z in zs)
    out[f"{tag}_c"] = f"""SELECT * REPLACE ({centred}, y - avg(y) FILTER (WHERE tr) {w} AS y),
        avg(y) FILTER (WHERE tr) {w} AS fit FROM {tag}_r"""
    previous = f"{tag}_c"
    for i, z in enumerate(zs):
        slope = lambda c, z=z: f"(sum({z} * {c}) FILTER (WHERE tr) {w} / sum({z} * {z}) FILTER (WHERE tr) {w})"
        rest = ", ".join(f"{o} - {z} * {slope(o)} AS {o}" for o in zs[i + 1:])
        replace = f"{rest + ', ' if rest else ''}y - {z} * {slope('y')} AS y, fit + {z} * {slope('y')} AS fit"
        name = tag if i == len(zs) - 1 else f"{tag}_{i}"
        last = f", {slope('y')} AS b_last" if i == len(zs) - 1 else ""
        out[name] = f"SELECT * REPLACE ({replace}){last} FROM {previous}"
        previous = name
    return out


ERRORS = """sqrt(avg(pow(target - pred, 2))) AS rmse, avg(abs(target - pred)) AS mae,
    CASE WHEN min(target) < max(target) THEN 1 - sum(pow(target - pred, 2)) / (var_pop(target) * count(*)) END AS r2_oos, count(*) AS n_obs"""


def build(final: str, **extra: str) -> str:
    """WITH clause of every CTE the statement needs, in dependency order."""
    known = CTES | extra
    done: dict[str, str] = {}

    def need(text: str) -> None:
        for name in known:
            if name not in done and re.search(rf"\b{name}\b", text):
                done[name] = ""
                need(known[name])
                done.pop(name)
                done[name] = known[name]

    need(final)
    recursive = "RECURSIVE " if any(re.search(rf"(FROM|JOIN) {k}\b", v) for k, v in done.items()) else ""
    parts = [f"{k} AS ({v})" for k, v in done.items()]
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + final if parts else final


def ablation_ctes(ds: str, scheme: str, layer: list[str], log: bool = True) -> dict[str, str]:
    y = "CASE WHEN target > 0 THEN ln(target) END" if log else "target"
    back = "exp(fit)" if log else "fit"
    return (
        folds(ds, scheme)
        | regression("reg_b", ds, HAR, y)
        | regression("reg_l", ds, layer, y)
        | {
            "preds": f"""SELECT series_id, 'base' AS config, fold, date, target, {back} AS pred FROM reg_b WHERE te
                UNION ALL BY NAME SELECT series_id, 'layer' AS config, fold, date, target, {back} AS pred FROM reg_l WHERE te""",
            "per_fold": f"SELECT series_id, config, fold, {ERRORS} FROM preds GROUP BY ALL",
            "pooled": f"SELECT series_id, config, {ERRORS} FROM preds GROUP BY ALL",
        }
    )


def garch(columns: str) -> str:
    """A likelihood search of its own: a grid over the whole region, seven finer ones around the cheapest point, each a list fold per candidate, then
    Newton steps in (ω, α, β) whose derivatives are folded along the days by hand. β stays at 0 where the grids end there."""
    moves = ", ".join(f"({i})" for i in (-2, -1, 0, 1, 2))
    rounds, steps = 7, (0.05, 0.05, 0.2)
    cost = """list_reduce(days, lambda k, e: {x: 0.0::DOUBLE, s: o + a * e.x + b * k.s, t: k.t + (ln(k.s) + e.x / k.s)}, {x: 0.0::DOUBLE, s: o + (a + b) * s0, t: 0.0::DOUBLE}).t"""
    ctes = {
        "gv": "SELECT series_id, date, ret * ret AS variance FROM price_ret WHERE ret IS NOT NULL",
        "gh": f"SELECT *, variance AS rv_d, {mean('variance', 5)} AS rv_w, {mean('variance', 22)} AS rv_m, {target(H)} AS target FROM gv",
        "ds_g": dataset(HAR, source="gh"),
        **folds("ds_g", "purged"),
        "g_fold": """SELECT f.series_id, f.fold, max(date) FILTER (WHERE rn = train_end - 1) AS train_last, max(date) FILTER (WHERE rn = test_end - 1) AS test_last
            FROM folds f JOIN ds_g d USING (series_id) GROUP BY ALL""",
        "g_day": "SELECT series_id, date, (ret * 100) * (ret * 100) AS x, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i FROM price_ret WHERE ret IS NOT NULL",
        "g_train": f"""SELECT series_id, fold, list({{x: x, s: 0.0::DOUBLE, t: 0.0::DOUBLE}} ORDER BY date) AS days, list(x ORDER BY date) AS xs, avg(x) AS var,
            sum(pow(0.94, i) * x) FILTER (WHERE i < 75) / sum(pow(0.94, i)) FILTER (WHERE i < 75) AS s0, test_last
            FROM g_fold JOIN g_day USING (series_id) WHERE date <= train_last GROUP BY ALL HAVING count(*) >= {LEAST_ROWS} AND max(x) > 0""",
        "p0": """SELECT series_id, fold, i / 10.0::DOUBLE AS a, j / 10.0::DOUBLE AS b, l * 0.4::DOUBLE AS c FROM g_train, range(10) u(i), range(10) v(j), range(-3, 4) w(l) WHERE i + j < 10""",
    }
    for k in range(rounds + 1):
        if k:
            sa, sb, sc = (v / 2 ** (k - 1) for v in steps)
            ctes[f"p{k}"] = f"""SELECT series_id, fold, greatest(a + i * {sa!r}::DOUBLE, 0) AS a, greatest(b + j * {sb!r}::DOUBLE, 0) AS b, c + l * {sc!r}::DOUBLE AS c
                FROM z{k - 1}, (VALUES {moves}) u(i), (VALUES {moves}) v(j), (VALUES {moves}) w(l)"""
        ctes[f"z{k}"] = f"""SELECT series_id, fold, p['a'] AS a, p['b'] AS b, p['c'] AS c FROM (SELECT series_id, fold, arg_min({{a: a, b: b, c: c}}, cost) AS p FROM (
            SELECT series_id, fold, a, b, c, {cost} AS cost
            FROM (SELECT DISTINCT p.*, days, s0, var * (1 - a - b) * exp(c) AS o FROM p{k} p JOIN g_train USING (series_id, fold) WHERE a + b <= {MOST_PERSISTENCE}))
            GROUP BY ALL)"""
    # s and its derivatives by ω, α, β (d…), those with β again (e…), then the sums of first (g…) and second derivatives (h…).
    names = "s do_ da db eo ea eb go ga gb hoo hoa hob haa hab hbb".split()
    zero = ", ".join(f"{n}: 0.0::DOUBLE" for n in names)
    ctes["y0"] = f"SELECT series_id, fold, var * (1 - a - b) * exp(c) AS o, a, b, b = 0 AS held FROM z{rounds} JOIN g_train USING (series_id, fold)"
    first, second = "(0.5 * (1 - e.x / k.s) / k.s)", "(0.5 * (2 * e.x / k.s - 1) / (k.s * k.s))"
    pair = lambda n, p, q, m="": f"h{n}: k.h{n} + {second} * k.{p} * k.{q}" + (f" + {first} * k.{m}" if m else "")
    for k in range(6):
        ctes[f"n{k}"] = f"""SELECT series_id, fold, o, a, b, held, list_reduce(list_transform(xs, lambda x: {{x: x, {zero}}}), lambda k, e: {{x: 0.0::DOUBLE,
                s: o + a * e.x + b * k.s, do_: 1 + b * k.do_, da: e.x + b * k.da, db: k.s + b * k.db, eo: k.do_ + b * k.eo, ea: k.da + b * k.ea, eb: 2 * k.db + b * k.eb,
                go: k.go + {first} * k.do_, ga: k.ga + {first} * k.da, gb: k.gb + {first} * k.db,
                {pair("oo", "do_", "do_")}, {pair("oa", "do_", "da")}, {pair("ob", "do_", "db", "eo")}, {pair("aa", "da", "da")}, {pair("ab", "da", "db", "ea")}, {pair("bb", "db", "db", "eb")}}},
                {{x: 0.0::DOUBLE, s: o + (a + b) * s0, do_: 1.0::DOUBLE, da: s0, db: s0, {", ".join(f"{n}: 0.0::DOUBLE" for n in names[4:])}}}) AS m
            FROM y{k} JOIN g_train USING (series_id, fold)"""
        ctes[f"q{k}"] = f"""SELECT series_id, fold, o, a, b, held, m.go AS g1, m.ga AS g2, CASE WHEN held THEN 0 ELSE m.gb END AS g3, m.hoo AS h11, m.hoa AS h12, m.haa AS h22,
            CASE WHEN held THEN 0 ELSE m.hob END AS h13, CASE WHEN held THEN 0 ELSE m.hab END AS h23, CASE WHEN held THEN 1 ELSE m.hbb END AS h33 FROM n{k}"""
        det = "(h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13))"
        ctes[f"y{k + 1}"] = f"""SELECT series_id, fold, held,
            o - (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / {det} AS o,
            a - (h11 * (g2 * h33 - h23 * g3) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / {det} AS a,
            b - (h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / {det} AS b FROM q{k}"""
    ctes |= {
        "g_fit": f"SELECT y.*, s0, test_last, {cost} / 2 AS cost FROM y6 y JOIN g_train USING (series_id, fold)",
        "g_path": """SELECT f.series_id, fold, date, i, o + a * x + b * (o + (a + b) * s0) AS s FROM g_fit f JOIN g_day d ON d.series_id = f.series_id AND i = 0 UNION ALL
            SELECT k.series_id, k.fold, d.date, d.i, o + a * d.x + b * k.s FROM g_path k JOIN g_fit f ON f.series_id = k.series_id AND f.fold = k.fold
            JOIN g_day d ON d.series_id = k.series_id AND d.i = k.i + 1 AND d.date <= f.test_last""",
        "g_pred": f"""SELECT p.series_id, p.fold, target, sqrt((o / (1 - a - b) + (s - o / (1 - a - b)) * (1 - pow(a + b, {H})) / ({H} * (1 - (a + b)))) / 10000 * 252) * 100 AS pred
            FROM g_path p JOIN g_fit f ON f.series_id = p.series_id AND f.fold = p.fold JOIN folds q ON q.series_id = p.series_id AND q.fold = p.fold
            JOIN ds_g d ON d.series_id = p.series_id AND d.date = p.date AND d.rn >= q.test_start AND d.rn < q.test_end""",
    }
    return build(columns, **ctes)


M3 = rs("rmse", "mae", "r2_oos")


def page_text() -> str:
    """Markup removal for the entities that the pages use; the ampersand is resolved last."""
    text = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
    for e, c in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;?", "&")):
        text = f"regexp_replace({text}, '{e}', '{c}', 'g')"
    space = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return f"trim(regexp_replace({text}, '{space}', ' ', 'g'))"


def statements() -> dict[str, str]:
    q: dict[str, str] = {}
    q["bars_daily"] = build(f"SELECT series_id, date, {rs('open', 'high', 'low', 'close')}, trades FROM bars")
    q["har_features"] = build(f"SELECT series_id, date, {rs('rv_d', 'rv_w', 'rv_m')} FROM har")
    q["har_features_close"] = build(
        f"SELECT series_id, date, {rs('rv_d', 'rv_w', 'rv_m')} FROM hc",
        hc=f"SELECT *, variance AS rv_d, {mean('variance', 5)} AS rv_w, {mean('variance', 22)} AS rv_m FROM cv",
        cv=f"SELECT series_id, date, pow(ln(close) - lag(ln(close)) OVER {P}, 2) AS variance FROM bars",
    )
    q["forward_target"] = build(f"SELECT series_id, date, {r(target(5), 'target_5')}, {r(target(21), 'target_21')} FROM varied")
    sd = lambda n: f"(CASE WHEN count(ret) OVER {rows(n)} >= {n} THEN stddev_samp(ret) OVER {rows(n)} END) * sqrt(252) * 100"
    q["realized_vol"] = build(f"SELECT series_id, date, {r(sd(5), 'rv_5')}, {r(sd(21), 'rv_21')} FROM price_ret")
    q["range_vol"] = build(f"SELECT series_id, date, {rs('range_vol_21')} FROM vol21")
    q["semivariance_overnight"] = build(f"SELECT series_id, date, {rs('variance', 'overnight', 'rv_d_pos', 'rv_d_neg')} FROM extended")

    def skew(h: int) -> str:
        w = rows(0, h)
        n, s1, s2, s3 = (f"{f} OVER {w}" for f in ("count(ret)", "sum(ret)", "sum(ret * ret)", "sum(ret * ret * ret)"))
        m = f"(({s1}) / ({n}))"
        m2 = f"(({s2}) / ({n}) - {m} * {m})"
        m3 = f"(({s3}) / ({n}) - 3 * {m} * ({s2}) / ({n}) + 2 * {m} * {m} * {m})"
        adjusted = f"sqrt(({n}) * (({n}) - 1.0)) / (({n}) - 2) * {m3} / pow({m2}, 1.5)"
        return f"CASE WHEN count(*) OVER {w} = {h} AND {n} >= {max(3, h - 3)} THEN {adjusted} END"

    q["forward_skew"] = build(f"SELECT series_id, date, {r(skew(10), 'skew_10')}, {r(skew(21), 'skew_21')} FROM price_ret")
    q["exogenous_changes"] = build(f"SELECT date, {rs('vix_level', 'vix_change', 'dxy_return')} FROM risk_changes")
    w63 = rows(63)
    q["surprise_zscore"] = build(
        f"""SELECT series_id, CAST(date AS TIMESTAMP) AS date, {r('share_pct')}, {r(f'''(share_pct - {mean('share_pct', 63, minimum=21)})
        / nullif(CASE WHEN count(share_pct) OVER {w63} >= 21 AND min(share_pct) OVER {w63} < max(share_pct) OVER {w63}
        THEN stddev_samp(share_pct) OVER {w63} END, 0)''', 'surprise')} FROM hourly""",
        hourly="""SELECT series_id, date, events / total * 100 AS share_pct FROM (SELECT event_type AS series_id,
            date_trunc('hour', ts) AS date, count(*) AS events FROM events GROUP BY ALL) JOIN (SELECT date_trunc('hour', ts)
            AS date, count(*) AS total FROM events GROUP BY ALL) USING (date)""",
    )
    q["smoothed_attention"] = build(f"SELECT date, {r(mean('share_pct', 21, '', 'date', 1), 'share_pct')} FROM attention")
    q["spike_days"] = build(
        f"""SELECT series_id, date AS spike_date, {r('v', 'spike_value')}, CAST(date - 3 AS DATE) AS window_start,
            CAST(date + 3 AS DATE) AS window_end FROM walk WHERE taken_now""",
        z=f"""SELECT series_id, date, (value - {mean('value', 63, minimum=21)}) / nullif(CASE WHEN count(value) OVER {w63} >= 21
            THEN stddev_samp(value) OVER {w63} END, 0) AS v FROM official""",
        best="SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY v DESC, date) AS k FROM z WHERE v IS NOT NULL",
        walk="""SELECT series_id, k, date, v, true AS taken_now, [date] AS taken FROM best WHERE k = 1 UNION ALL
            SELECT b.series_id, b.k, b.date, b.v, ok, CASE WHEN ok THEN list_append(taken, b.date) ELSE taken END
            FROM (SELECT b.*, w.taken, len(w.taken) < 15 AND len(list_filter(w.taken, lambda x: abs(date_diff('day', x, b.date)) < 10)) = 0 AS ok
            FROM walk w JOIN best b ON b.series_id = w.series_id AND b.k = w.k + 1 WHERE len(w.taken) < 15) b""",
    )
    q["gap_breaks"] = build(
        f"""SELECT series_id, CAST(date AS TIMESTAMP) AS ts, {r('close')}, false AS is_break FROM prices UNION ALL
            SELECT series_id, CAST(date AS TIMESTAMP) - INTERVAL 1 DAY, NULL, true
            FROM (SELECT *, date - lag(date) OVER {P} AS hole FROM prices) WHERE hole > 2"""
    )
    q["thinned_rows"] = build(
        f"""SELECT series_id, date, rn, n, {r('close')} FROM (SELECT *, row_number() OVER {P} - 1 AS rn,
            count(*) OVER (PARTITION BY series_id) AS n FROM prices) WHERE rn % 21 = 0"""
    )
    q["asof_series"] = build(
        f"""SELECT l.series_id, l.date, {r('x.value', 'value')} FROM (
            SELECT o_orderpriority AS series_id, CAST(CAST(o_orderdate AS DATE) + 3 AS DATE) AS date FROM orders GROUP BY ALL) l ASOF LEFT JOIN monthly x
            ON l.series_id = x.series_id AND l.date >= x.date""",
        monthly="""SELECT series_id, CAST(l_date AS DATE) AS date, CASE WHEN day(l_date) <> 10 THEN value END AS value
            FROM (SELECT series_id, date AS l_date, value FROM official)""",
    )
    q["asof_shared_pair"] = build(
        f"SELECT l.series_id, l.date, {rs('vix_level', 'vix_change', 'dxy_return')} FROM prices l ASOF LEFT JOIN risk_changes x ON l.date >= x.date"
    )
    q["asof_shared_instant"] = f"""SELECT l.series_id, l.date, l.events, x.last_hour, {r('x.most', 'most')} FROM
        (SELECT event_type AS series_id, CAST(ts AS DATE) AS date, count(*) AS events FROM events GROUP BY ALL) l ASOF LEFT JOIN
        (SELECT date_trunc('hour', ts) AS h, count(*) AS last_hour, max(value) AS most FROM events GROUP BY 1) x ON CAST(l.date AS TIMESTAMP) + INTERVAL 3 HOUR >= x.h"""
    q["asof_intraday"] = build(
        f"""SELECT e.event_id, e.user_id, {r('last_purchase')} FROM (SELECT * FROM events WHERE event_type = 'error') e
            ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS last_purchase FROM events WHERE event_type = 'purchase' GROUP BY ALL) p
            ON e.user_id = p.user_id AND e.ts >= p.ts"""
    )
    q["asof_release_date"] = build(
        """SELECT l.series_id, l.date, x.reference_date, x.value FROM official l ASOF LEFT JOIN activity x
            ON l.series_id = x.series_id AND l.date >= x.release_date"""
    )
    q["calendar_intersection"] = build(
        """SELECT series_id, count(*) AS n_days, min(date) AS first_date, max(date) AS last_date FROM prices
            WHERE date IN (SELECT date FROM attention) AND date IN (SELECT date FROM risk) GROUP BY series_id"""
    )
    changed = "coalesce(ticker <> lag(ticker) OVER (ORDER BY date), false) AS contract_changed"
    fields = f"'front' AS series_id, date, ticker, {rs('settlement', 'open', 'last', 'low', 'high')}, {changed}"
    q["front_contract_row"] = build(f"SELECT {fields} FROM front_row")
    q["front_contract_filled"] = build(f"SELECT {fields} FROM front_filled")
    q["sample_profile"] = build(
        f"""SELECT 'front' AS series_id, count(*) AS n_sessions, min(date) AS first_date, max(date) AS last_date,
            count(DISTINCT ticker) AS n_contracts, count(*) FILTER (WHERE contract_changed) AS n_rolls
            FROM (SELECT *, {changed} FROM front_filled)"""
    )
    q["roll_free_returns"] = build(
        f"""SELECT date, ticker, contract_changed, {r('CASE WHEN NOT contract_changed THEN ret END', 'ret')} FROM (SELECT *, {changed},
            ln(settlement) - lag(ln(settlement)) OVER (ORDER BY date) AS ret FROM front_filled)"""
    )
    for name, direction in (("keep_latest", "DESC"), ("keep_first", "ASC")):
        q[name] = f"""SELECT user_id, event_type, CAST(ts AS DATE) AS date, value, event_id FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS DATE) {direction}, event_id {direction}) = 1"""
    q["upsert_latest"] = f"""SELECT user_id, date, {r('value')} FROM (
        SELECT user_id, CAST(ts AS DATE) AS date, max(value) AS value, 0 AS batch FROM events WHERE ts < '2024-01-22' GROUP BY ALL
        UNION ALL SELECT user_id, CAST(ts AS DATE), max(value + 1000), 1 FROM events WHERE ts >= '2024-01-15' GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY batch DESC) = 1"""
    q["upsert_table_partitioned"] = q["upsert_latest"]
    index = f"""{r('avg(signed_score)', 'sentiment_mean')}, {r("avg(CASE WHEN label = 'NEGATIVE' THEN 1.0 ELSE 0.0 END)", 'share_negative')},
        count(label) AS n_texts"""
    q["sentiment_daily"] = build(
        f"SELECT date, {index} FROM lab GROUP BY date",
        lab="""SELECT date, CASE WHEN toxic = 1 THEN 'NEGATIVE' WHEN quality = 1 THEN 'POSITIVE' ELSE 'NEUTRAL' END AS label,
            CASE WHEN toxic = 1 THEN -0.75 WHEN quality = 1 THEN 0.75 ELSE 0.0 END AS signed_score FROM headlines JOIN labels USING (doc_id)""",
    )
    q["stream_text_index"] = q["sentiment_daily"]
    q["headlines_scored"] = build(f"SELECT doc_id, label, {rs('score', 'signed_score')} FROM scored")
    q["headlines_index"] = build(f"SELECT date, {index} FROM scored WHERE query = 'src1' AND language = 'en' GROUP BY date")
    q["headlines_model"] = build(
        f"SELECT date, {index} FROM m GROUP BY date",
        m="""SELECT date, CASE length(title) % 3 WHEN 0 THEN 'NEGATIVE' WHEN 1 THEN 'NEUTRAL' ELSE 'POSITIVE' END AS label,
            (length(title) % 3 - 1) * (length(title) % 7) / 8.0 AS signed_score FROM headlines""",
    )
    words_of = r"list_slice(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1, 512)"
    asked = f"""SELECT doc_id, text, len(list_filter({words_of}, lambda w: length(w) >= 8)) AS a, len(list_filter({words_of}, lambda w: length(w) <= 3)) AS b
        FROM documents"""
    side = "CASE WHEN text IS NULL THEN NULL WHEN a > b THEN 'POSITIVE' WHEN b > a THEN 'NEGATIVE' ELSE 'NEUTRAL' END"
    q["documents_model"] = f"SELECT doc_id, {side} AS label, {r('(a - b) / greatest(a + b, 1)::DOUBLE', 'signed_score')} FROM ({asked})"
    q["documents_model_texts"] = f"""SELECT count(*) AS scored_texts, count(*) FILTER (label = 'POSITIVE') AS positive
        FROM (SELECT DISTINCT text, {side} AS label FROM ({asked}) WHERE text IS NOT NULL)"""
    q["combined_corpus"] = build(
        f"SELECT date, {index} FROM both_scored GROUP BY date",
        both_scored=lexicon("corpus", "text"),
        corpus=f"""SELECT date, title AS text FROM headlines UNION ALL SELECT
            CAST(DATE '{FIRST_DAY}' + CAST(page_id % {HEADLINE_DAYS} AS INTEGER) AS DATE), html FROM pages""",
    )
    q["html_text"] = f"SELECT page_id, {page_text()} AS text, sha1(url)[1:10] AS slug FROM pages"
    q["event_properties"] = f"""SELECT event_type, count(k) AS n, min(k) AS min_k, max(k) AS max_k, {r('avg(k)', 'avg_k')}
        FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY event_type"""
    q["date_chunks"] = build(
        """SELECT series_id, CAST(a + 101 * i AS DATE) AS chunk_start, CAST(least(b, a + 101 * i + 100) AS DATE) AS chunk_end
            FROM (SELECT series_id, min(date) AS a, max(date) AS b FROM official GROUP BY 1), range(0, 10000) t(i)
            WHERE a + 101 * CAST(i AS INTEGER) <= b"""
    ).replace("101 * i", "101 * CAST(i AS INTEGER)")
    q["blended_target_gap"] = build(f"SELECT date, {rs('gap', 'dispersion', 'theta_baseline')} FROM anchored")
    q["hp_gap"] = build(
        f"SELECT series_id, reference_date, release_date, value, {r('CASE WHEN i >= 24 THEN y - level END', 'gap')} FROM kf",
        act="""SELECT *, ln(value) AS y, row_number() OVER (PARTITION BY series_id ORDER BY reference_date) - 1 AS i FROM activity""",
        kf=f"""SELECT series_id, reference_date, release_date, value, y, i, y AS level, CAST(0 AS DOUBLE) AS before, CAST(1 AS DOUBLE) AS p11,
            CAST(0 AS DOUBLE) AS p12, CAST(1 AS DOUBLE) AS p22 FROM act WHERE i = 0 UNION ALL
            SELECT a.series_id, a.reference_date, a.release_date, a.value, a.y, a.i,
            CASE WHEN a.i = 1 THEN a.y ELSE 2 * k.level - k.before + g.a11 / (g.a11 + 1) * (a.y - 2 * k.level + k.before) END,
            CASE WHEN a.i = 1 THEN k.level ELSE k.level + g.a12 / (g.a11 + 1) * (a.y - 2 * k.level + k.before) END,
            CASE WHEN a.i = 1 THEN 1 ELSE g.a11 / (g.a11 + 1) END, CASE WHEN a.i = 1 THEN 0 ELSE g.a12 / (g.a11 + 1) END,
            CASE WHEN a.i = 1 THEN 1 ELSE k.p11 - g.a12 * g.a12 / (g.a11 + 1) END
            FROM kf k JOIN act a ON a.series_id = k.series_id AND a.i = k.i + 1,
            LATERAL (SELECT 4 * k.p11 - 4 * k.p12 + k.p22 + {1 / MONTHLY_LAMBDA!r} AS a11, 2 * k.p11 - k.p12 AS a12) g""",
    )
    for name, ds in (("dataset_news", "news"), ("dataset_extended", "extended"), ("dataset_global_risk", "global_risk"),
                     ("dataset_credibility", "credibility"), ("dataset_fiscal", "fiscal")):
        q[name] = build(f"SELECT series_id, date, rn, n, {rs(*DATASETS[ds][0], 'target')} FROM ds_{ds}")
    for name, scheme in (("purged_folds", "purged"), ("step_folds", "steps"), ("expanding_cv_folds", "expanding"), ("single_split", "single")):
        q[name] = build(
            """SELECT f.series_id, CAST(f.fold AS BIGINT) AS fold, f.n, CAST(train_end AS BIGINT) AS train_end, CAST(test_start AS BIGINT)
                AS test_start, CAST(test_end AS BIGINT) AS test_end, count(*) AS n_test, min(date) AS test_first, max(date) AS test_last
                FROM folds f JOIN ds_base d ON d.series_id = f.series_id AND d.rn >= test_start AND d.rn < test_end GROUP BY ALL""",
            **folds("ds_base", scheme),
        )
    q |= _forecasts() | _trading() | _diagnostics() | _sources()
    return q


def _forecasts() -> dict[str, str]:
    q: dict[str, str] = {}
    y = "CASE WHEN target > 0 THEN ln(target) END"
    naive = "SELECT *, sqrt(rv_m * 252) * 100 AS pred FROM ds_base"
    q["persistence_pooled"] = build(f"SELECT series_id, {M3}, n_obs FROM (SELECT series_id, {ERRORS} FROM naive GROUP BY 1)", naive=naive)
    q["sink_json"] = q["persistence_pooled"]
    q["persistence_per_fold"] = build(
        f"""SELECT series_id, CAST(fold AS BIGINT) AS fold, {M3}, n_obs FROM (SELECT d.series_id, fold, {ERRORS} FROM naive d JOIN folds f
            ON d.series_id = f.series_id AND d.rn >= test_start AND d.rn < test_end GROUP BY ALL)""",
        naive=naive, **folds("ds_base", "purged"),
    )
    coefs = folds("ds_base", "purged")
    for last in HAR:
        coefs |= regression(f"reg_{last}", "ds_base", [f for f in HAR if f != last] + [last], y)
    one = lambda f: f"SELECT series_id, fold, any_value(b_last) AS b, count(*) FILTER (WHERE tr) AS n_train FROM reg_{f} GROUP BY ALL"
    q["ols_walk_forward"] = build(
        f"""SELECT series_id, CAST(fold AS BIGINT) AS fold, n_train, {r('ybar - c1.b * x1 - c2.b * x2 - c3.b * x3', 'intercept')},
            {r('c1.b / 1e4', 'b_rv_d')}, {r('c2.b / 1e4', 'b_rv_w')}, {r('c3.b / 1e4', 'b_rv_m')} FROM c1 JOIN (SELECT * EXCLUDE (n_train) FROM c2) c2 USING (series_id, fold)
            JOIN (SELECT * EXCLUDE (n_train) FROM c3) c3 USING (series_id, fold) JOIN means USING (series_id, fold)""",
        c1=one("rv_d"), c2=one("rv_w"), c3=one("rv_m"),
        means=f"""SELECT d.series_id, fold, avg({y}) AS ybar, avg(rv_d) AS x1, avg(rv_w) AS x2, avg(rv_m) AS x3
            FROM ds_base d JOIN folds f ON d.series_id = f.series_id AND rn < train_end GROUP BY ALL""",
        **coefs,
    )
    level = folds("ds_level", "purged") | regression("reg", "ds_level", [*HAR, "level"], "target")
    q["ols_level_feature"] = build(
        f"SELECT series_id, CAST(fold AS BIGINT) AS fold, {r('any_value(b_last)', 'b_level')}, {r('avg(fit) FILTER (WHERE te)', 'mean_fit')} FROM reg GROUP BY ALL",
        ds_level=dataset([*HAR, "level"], extra=", close + 4995 AS level"), **level,
    )
    har = folds("ds_base", "purged") | regression("reg", "ds_base", HAR, y)
    q["oos_forecast"] = build(
        f"SELECT series_id, CAST(fold AS BIGINT) AS fold, date, {r('target')}, {r('exp(fit)', 'rv_forecast')} FROM reg WHERE te", **har
    )
    q["directional_accuracy"] = build(
        f"""SELECT series_id, CAST(fold AS BIGINT) AS fold, n, hits, {r('hits / n', 'accuracy')}, {r('''CASE WHEN 2 * least(hits, n - hits) >= n THEN 1.0
            ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(hits, n - hits) + 1), lambda i:
            exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END''', 'p_value')} FROM (
            SELECT series_id, fold, count(*) AS n, count(*) FILTER (WHERE sign(exp(fit) - ref) = sign(target - ref)) AS hits
            FROM (SELECT *, sqrt(rvm * 252) * 100 AS ref FROM reg WHERE te) GROUP BY ALL)""",
        **har,
    )
    residual = "target - sqrt(rv_m * 252) * 100"
    q["residual_corrected"] = build(
        f"""SELECT series_id, CAST(fold AS BIGINT) AS fold, date, {r('greatest(sqrt(rvm * 252) * 100 + fit, 0.0)', 'rv_forecast')}
            FROM reg WHERE te""",
        **folds("ds_base", "purged"), **regression("reg", "ds_base", HAR, residual),
    )
    w, a, b = GARCH_PARAMETERS
    p = a + b
    q["garch_known_parameters"] = build(
        f"""SELECT series_id, date, {r(f'sqrt(({w / (1 - p)!r} + (s - {w / (1 - p)!r}) * {(1 - p**H) / (H * (1 - p))!r}) / 10000 * 252) * 100',
            'garch_forecast')} FROM path_s""",
        scaled="SELECT series_id, date, ret * 100 AS x, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i FROM price_ret WHERE ret IS NOT NULL",
        back_cast="SELECT series_id, sum(pow(0.94, i) * x * x) / sum(pow(0.94, i)) AS s0 FROM scaled WHERE i < 75 GROUP BY 1",
        path_s=f"""SELECT series_id, date, i, {w} + {a} * x * x + {b} * ({w} + {p} * s0) AS s FROM scaled JOIN back_cast USING (series_id) WHERE i = 0 UNION ALL
            SELECT n.series_id, n.date, n.i, {w} + {a} * n.x * n.x + {b} * k.s FROM path_s k JOIN scaled n ON n.series_id = k.series_id AND n.i = k.i + 1""",
    )
    q["garch_walk_forward"] = garch(f"SELECT series_id, CAST(fold AS BIGINT) AS fold, {M3}, n_obs FROM (SELECT series_id, fold, {ERRORS} FROM g_pred GROUP BY ALL)")
    q["garch_parameters"] = garch(f"SELECT series_id, CAST(fold AS BIGINT) AS fold, {rs('omega', 'alpha', 'beta', 'cost')}, true AS converged FROM (SELECT series_id, fold, o AS omega, a AS alpha, b AS beta, cost FROM g_fit)")
    parts = folds("ds_extended", "purged")
    for tag, fs in (("reg_a", HAR), ("reg_b", HAR + ["overnight"]), ("reg_c", ["rv_d_pos", "rv_d_neg", "rv_w", "rv_m"])):
        parts |= regression(tag, "ds_extended", fs, y)
    union = " UNION ALL ".join(f"SELECT series_id, date, exp(fit) AS f FROM {t} WHERE te" for t in ("reg_a", "reg_b", "reg_c"))
    q["ensemble_forecast"] = build(f"SELECT series_id, date, {r('avg(f)', 'rv_forecast')} FROM every_set GROUP BY ALL", every_set=union, **parts)

    news = ablation_ctes("ds_news", "purged", HAR + ["news"])
    q["ablation_news_folds"] = build(f"SELECT series_id, config, CAST(fold AS BIGINT) AS fold, {M3}, n_obs FROM per_fold", **news)
    q["ablation_news_pooled"] = build(
        f"""SELECT series_id, config, {M3}, n_obs, {rs('mean_rmse', 'mean_mae', 'mean_r2_oos')}, n_folds FROM pooled JOIN (SELECT series_id, config,
            avg(rmse) AS mean_rmse, avg(mae) AS mean_mae, avg(r2_oos) AS mean_r2_oos, count(*) AS n_folds FROM per_fold GROUP BY ALL)
            USING (series_id, config)""",
        **news,
    )
    q["ablation_news_verdict"] = build(
        f"""SELECT series_id, {rs('base_r2', 'other_r2')}, {r('other_r2 - base_r2', 'delta_r2')}, better, worse, n_folds,
            CASE WHEN base_r2 < 0 THEN 'none' WHEN base_r2 < 0.10 THEN 'weak' ELSE 'fair' END AS forecast_verdict,
            CASE WHEN other_r2 - base_r2 > 0.02 AND better > worse THEN 'helps' WHEN other_r2 - base_r2 > 0 THEN 'inconsistent' ELSE 'no help' END
            AS layer_verdict FROM (SELECT series_id, max(r2_oos) FILTER (WHERE config = 'base') AS base_r2, max(r2_oos) FILTER
            (WHERE config = 'layer') AS other_r2 FROM pooled GROUP BY 1) JOIN (SELECT series_id, count(*) FILTER (WHERE o > b) AS better,
            count(*) FILTER (WHERE o < b) AS worse, count(*) AS n_folds FROM (SELECT series_id, fold, max(r2_oos) FILTER (WHERE config = 'base') AS b,
            max(r2_oos) FILTER (WHERE config = 'layer') AS o FROM per_fold GROUP BY ALL) GROUP BY 1) USING (series_id)""",
        **news,
    )
    pooled = f"SELECT series_id, config, {M3}, n_obs FROM pooled"
    q["ablation_attention"] = build(pooled, **ablation_ctes("ds_attention_news", "purged", HAR + ["news"]))
    q["ablation_attention_level"] = build(pooled, **ablation_ctes("ds_attention_level", "purged", HAR + ["news"]))
    q["ablation_fiscal"] = build(pooled, **ablation_ctes("ds_fiscal", "purged", DATASETS["fiscal"][0]))
    q["ablation_credibility"] = build(pooled, **ablation_ctes("ds_credibility", "purged", DATASETS["credibility"][0]))
    q["ablation_monthly_steps"] = build(pooled, **ablation_ctes("ds_news", "steps", HAR + ["news"]))
    q["ablation_single_split"] = build(
        f"SELECT series_id, config, {M3}, n_obs FROM per_fold", **ablation_ctes("ds_news", "single", HAR + ["news"], log=False)
    )
    q["ablation_expanding"] = build(
        f"""SELECT series_id, config, {M3}, n_folds FROM (SELECT series_id, config, avg(rmse) AS rmse, avg(mae) AS mae,
            avg(r2_oos) AS r2_oos, count(*) AS n_folds FROM per_fold GROUP BY ALL)""",
        **ablation_ctes("ds_news", "expanding", HAR + ["news"], log=False),
    )
    labels = " UNION ALL ".join(f"SELECT *, {h} AS horizon, {target(h)} AS target FROM hs" for h in (1, 3, 5, 10, 15, 21))
    q["horizon_sweep"] = build(
        f"""SELECT series_id, CAST(horizon AS INTEGER) AS horizon, model, {M3}, n_obs FROM (SELECT series_id, horizon, model, {ERRORS} FROM (
            SELECT series_id, horizon, 'har' AS model, target, exp(fit) AS pred FROM reg WHERE te UNION ALL BY NAME
            SELECT series_id, horizon, 'persistence' AS model, target, sqrt(rvm * 252) * 100 AS pred FROM reg WHERE te) GROUP BY ALL)""",
        hs=f"SELECT *, variance AS rv_d, {mean('variance', 5)} AS rv_w, {mean('variance', 22)} AS rv_m FROM varied",
        long=labels,
        ds_sweep="""SELECT *, row_number() OVER (PARTITION BY series_id, horizon ORDER BY date) - 1 AS rn FROM long
            WHERE rv_d IS NOT NULL AND rv_w IS NOT NULL AND rv_m IS NOT NULL AND target IS NOT NULL""",
        sweep_sizes="SELECT series_id, horizon, count(*) AS n FROM ds_sweep GROUP BY ALL",
        sweep_folds="""SELECT series_id, horizon, i AS fold, n // 6 * i - horizon - 5 AS train_end, n // 6 * i AS test_start,
            n // 6 * (i + 1) AS test_end FROM sweep_sizes, range(1, 6) t(i) WHERE n // 6 * i > horizon + 5""",
        **regression("reg", "ds_sweep", HAR, y, keys="series_id, horizon", folds_cte="sweep_folds"),
    )
    return q


ATM = """SELECT series_id, refdate, tenor, CASE WHEN t1 IS NULL THEN iv2 WHEN t2 IS NULL THEN iv1 ELSE
    sqrt((pow(iv1 / 100, 2) * t1 + (tenor - t1) / (t2 - t1) * (pow(iv2 / 100, 2) * t2 - pow(iv1 / 100, 2) * t1)) / tenor) * 100 END AS iv_atm_pct
    FROM (SELECT series_id, refdate, tenor, max(t) FILTER (WHERE t < tenor) AS t1, arg_max(iv_pct, t) FILTER (WHERE t < tenor) AS iv1,
    min(t) FILTER (WHERE t >= tenor) AS t2, arg_min(iv_pct, t) FILTER (WHERE t >= tenor) AS iv2 FROM (SELECT *, CAST(maturity_date - refdate AS DOUBLE) AS t
    FROM surface WHERE delta_pct = 50), (VALUES {tenors}) v(tenor) GROUP BY ALL)"""


def black(f: str, k: str, t: str, sigma: str, rate: float) -> dict[str, str]:
    """Step columns of Black-76 as SQL over a relation named in the caller."""
    return {
        "d1": f"(ln({f} / {k}) + {sigma} * {sigma} / 2 * {t}) / ({sigma} * sqrt({t}))",
        "d2": f"(ln({f} / {k}) + {sigma} * {sigma} / 2 * {t}) / ({sigma} * sqrt({t})) - {sigma} * sqrt({t})",
        "disc": f"exp(-{rate} * {t})",
    }


CALL = f"disc * (f * {cdf('d1')} - k * {cdf('d2')})"
PUT = f"disc * (k * {cdf('(-d2)')} - f * {cdf('(-d1)')})"
VEGA = f"disc * f * (exp(-d1 * d1 / 2) / {SQRT_2PI!r}) * sqrt(t)"


def _trading() -> dict[str, str]:
    q: dict[str, str] = {}
    CTES["atm21"] = ATM.format(tenors="(21)")
    CTES["proxy"] = """SELECT v.series_id, v.date, v.range_vol_21 * (c.iv / c.rv) AS iv_proxy FROM vol21 v JOIN (
        SELECT a.series_id, any_value(a.iv_atm_pct) AS iv, arg_max(v.range_vol_21, v.date) AS rv FROM (SELECT * FROM atm21 QUALIFY row_number()
        OVER (PARTITION BY series_id ORDER BY refdate DESC) = 1) a JOIN vol21 v ON v.series_id = a.series_id AND v.date <= a.refdate
        AND v.range_vol_21 IS NOT NULL GROUP BY 1) c USING (series_id) WHERE v.range_vol_21 IS NOT NULL"""
    CTES["naive_fc"] = "SELECT series_id, 'all' AS config, date, sqrt(rv_m * 252) * 100 AS rv_forecast FROM ds_base"
    CTES["path"] = f"""SELECT series_id, date, close AS spot_entry, row_number() OVER {P} - 1 AS rn, lead(date, {H}) OVER {P} AS exit_date,
        lead(close, {H}) OVER {P} AS spot_exit FROM prices"""

    def trades(forecast: str, bands: tuple[float, ...]) -> dict[str, str]:
        values = ", ".join(f"(CAST({b} AS DOUBLE))" for b in bands)
        return {
            "cand": f"""SELECT series_id, config, band_pct, date, rn, exit_date, spot_entry, spot_exit, rv_forecast, iv_proxy,
                CASE WHEN rv_forecast - iv_proxy > band_pct THEN 1 WHEN rv_forecast - iv_proxy < -band_pct THEN -1 ELSE 0 END AS signal
                FROM path JOIN {forecast} USING (series_id, date) JOIN proxy USING (series_id, date), (VALUES {values}) b(band_pct)
                WHERE exit_date IS NOT NULL AND iv_proxy > 0 AND rv_forecast IS NOT NULL""",
            "cand_n": """SELECT *, row_number() OVER (PARTITION BY series_id, config, band_pct ORDER BY rn) AS k FROM cand WHERE signal <> 0""",
            "greedy": f"""SELECT series_id, config, band_pct, k, rn, true AS taken, rn + {H} AS free FROM cand_n WHERE k = 1 UNION ALL
                SELECT c.series_id, c.config, c.band_pct, c.k, c.rn, c.rn >= g.free, CASE WHEN c.rn >= g.free THEN c.rn + {H} ELSE g.free END
                FROM greedy g JOIN cand_n c ON c.series_id = g.series_id AND c.config = g.config AND c.band_pct = g.band_pct AND c.k = g.k + 1""",
            "kept": f"""SELECT c.*, spot_entry AS f, spot_entry AS k2, {H} / 365.0 AS t, iv_proxy / 100 AS sigma FROM cand_n c JOIN greedy g
                USING (series_id, config, band_pct, rn) WHERE taken""",
            "legs": """SELECT * EXCLUDE (k, k2), k2 AS k, (sigma * sigma / 2 * t) / (sigma * sqrt(t)) AS d1,
                (sigma * sigma / 2 * t) / (sigma * sqrt(t)) - sigma * sqrt(t) AS d2, 1.0 AS disc FROM kept""",
            "priced": f"""SELECT *, {CALL} + {PUT} AS premium, 1000.0 / (2 * {VEGA} * 0.01) AS n_contracts, abs(spot_exit - spot_entry) AS payoff
                FROM legs""",
            "pnl": """SELECT *, abs(n_contracts) * premium * 0.05 AS cost, signal * n_contracts * (payoff - premium) AS pnl_gross,
                signal * n_contracts * (payoff - premium) - abs(n_contracts) * premium * 0.05 AS pnl_net FROM priced""",
        }

    sharpe = f"""CASE WHEN count(*) > 1 THEN CASE WHEN min(ret) = max(ret) THEN 0.0 ELSE avg(ret) / stddev_samp(ret) * sqrt(252 / {H}) END END"""
    summary = f"""SELECT series_id, config, band_pct, count(*) AS n_trades, avg(CASE WHEN pnl_net > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
        sum(pnl_net) AS total_pnl, avg(pnl_net) AS avg_pnl, stddev_samp(pnl_net) AS pnl_std, {sharpe} AS sharpe,
        count(*) FILTER (WHERE signal = 1) AS n_long_vol, count(*) FILTER (WHERE signal <> 1) AS n_short_vol,
        (avg(pow(ret, 3)) - 3 * avg(ret) * avg(pow(ret, 2)) + 2 * pow(avg(ret), 3)) / pow(var_pop(ret), 1.5) AS skew,
        (avg(pow(ret, 4)) - 4 * avg(ret) * avg(pow(ret, 3)) + 6 * pow(avg(ret), 2) * avg(pow(ret, 2)) - 3 * pow(avg(ret), 4))
        / pow(var_pop(ret), 2) AS kurt FROM (SELECT *, pnl_net / abs(n_contracts * premium) AS ret FROM pnl) GROUP BY ALL"""
    money = rs("rv_forecast", "iv_proxy", "n_contracts", "premium", "payoff", "cost", "pnl_gross", "pnl_net")

    q["atm_iv_tenors"] = build(
        f"SELECT series_id, refdate, CAST(tenor AS INTEGER) AS tenor, CAST(refdate + CAST(tenor AS INTEGER) AS DATE) AS target_date, {r('iv_atm_pct')} FROM atm",
        atm=ATM.format(tenors="(5), (21), (42), (60), (90)"),
    )
    quoted = """SELECT q.*, p.close AS spot, (q.maturity_date - q.refdate) / 365.0 AS t, q.iv_pct / 100 AS sigma FROM
        (SELECT * FROM surface WHERE delta_pct = 50) q ASOF LEFT JOIN prices p ON q.series_id = p.series_id AND q.refdate >= p.date"""
    b = black("f", "k", "t", "sigma", 0.1)
    q["black76_chain"] = build(
        f"""SELECT series_id, refdate, maturity_date, m, {r(CALL, 'call')}, {r(PUT, 'put')}, {r(VEGA, 'vega')}, {r('2 * ' + VEGA, 'straddle_vega')}
            FROM (SELECT *, {b['d1']} AS d1, {b['d2']} AS d2, {b['disc']} AS disc FROM (SELECT *, spot AS f, spot * m AS k FROM quoted,
            (VALUES (CAST(0.95 AS DOUBLE)), (0.98), (1.0), (1.02), (1.05)) v(m)))""",
        quoted=quoted,
    )
    b = black("f", "k", "t", "sigma", 0.0)
    q["vega_sizing"] = build(
        f"""SELECT series_id, refdate, maturity_date, {r('vp', 'vega_point')}, {r('1000 / vp', 'n_contracts')}, {r('abs(1000 / vp) * premium * 0.05', 'cost')},
            {r('abs(1000 / vp) * premium * 0.05 + abs(1000 / vp) * premium * 0.5 * 0.05', 'round_trip')} FROM (SELECT *, 2 * {VEGA} * 0.01 AS vp,
            {CALL} + {PUT} AS premium FROM (SELECT *, {b['d1']} AS d1, {b['d2']} AS d2, {b['disc']} AS disc FROM
            (SELECT *, spot AS f, spot AS k FROM quoted)))""",
        quoted=quoted,
    )
    q["iv_proxy"] = build(f"SELECT series_id, date, {r('iv_proxy')} FROM proxy")
    q["signal_days"] = build(
        """SELECT series_id, date, CASE WHEN rv_forecast - iv_proxy > 1 THEN 1 WHEN rv_forecast - iv_proxy < -1 THEN -1 ELSE 0 END AS signal
            FROM naive_fc JOIN proxy USING (series_id, date)"""
    )
    bands = (0.5, 1.0, 1.5, 2.0)
    q["backtest_trades"] = build(
        f"SELECT series_id, band_pct, date AS entry_date, exit_date, signal, {money} FROM pnl", **trades("naive_fc", bands)
    )
    q["sink_csv"] = build(f"SELECT series_id, band_pct, date AS entry_date, exit_date, signal, {money} FROM pnl", **trades("naive_fc", (1.0,)))
    grid = "SELECT DISTINCT series_id, band_pct FROM prices, (VALUES (CAST(0.5 AS DOUBLE)), (1.0), (1.5), (2.0)) b(band_pct)"
    shown = f"""coalesce(n_trades, 0) AS n_trades, {rs('win_rate', 'total_pnl', 'avg_pnl', 'pnl_std', 'sharpe')}, n_long_vol, n_short_vol"""
    q["backtest_summary"] = build(
        f"SELECT series_id, band_pct, {shown} FROM grid LEFT JOIN summary USING (series_id, band_pct)",
        grid=grid, summary=summary, **trades("naive_fc", bands),
    )
    inv = NormalDist().inv_cdf
    e = 2.718281828459045
    trial_rows = ", ".join(
        f"({n}, {(1 - EULER_MASCHERONI) * inv(1 - 1 / n) + EULER_MASCHERONI * inv(1 - 1 / (n * e))!r})" for n in range(2, 5)
    )
    q["band_grid_dsr"] = build(
        f"""SELECT series_id, {r('sharpe')}, n_trades, n_trials, {r('trials_sd')}, {r('benchmark')}, {r(cdf('z'), 'dsr')} FROM (SELECT *,
            (sharpe - benchmark) * sqrt(n_trades - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) AS z FROM (
            SELECT series_id, max(sharpe) FILTER (WHERE band_pct = 1) AS sharpe, max(n_trades) FILTER (WHERE band_pct = 1) AS n_trades,
            max(skew) FILTER (WHERE band_pct = 1) AS skew, max(kurt) FILTER (WHERE band_pct = 1) AS kurt,
            count(sharpe) FILTER (WHERE n_trades > 1) AS n_trials, stddev_samp(sharpe) FILTER (WHERE n_trades > 1) AS trials_sd,
            CASE WHEN max(n_trades) FILTER (WHERE band_pct = 1) > 1 THEN stddev_samp(sharpe) FILTER (WHERE n_trades > 1) * any_value(bar) END AS benchmark
            FROM (SELECT *, count(*) FILTER (WHERE n_trades > 1) OVER (PARTITION BY series_id) AS nt FROM summary)
            LEFT JOIN (VALUES {trial_rows}) v(nn, bar) ON nn = nt GROUP BY 1))""",
        summary=summary, **trades("naive_fc", bands),
    )
    q["running_pnl"] = build(
        f"""SELECT series_id, exit_date AS date, {r('pnl_net')}, {r('sum(pnl_net) OVER (PARTITION BY series_id ORDER BY exit_date ROWS UNBOUNDED PRECEDING)',
            'running')} FROM pnl""",
        **trades("naive_fc", (1.0,)),
    )
    newest = "QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY {t} DESC) = 1"
    d1 = "(sigma * sqrt(t) / 2)"
    q["signal_today"] = build(
        f"""SELECT series_id, date, refdate, spot_date, CASE WHEN range_vol_21 - iv_atm_pct > 1 THEN 1 WHEN range_vol_21 - iv_atm_pct < -1 THEN -1 ELSE 0 END
            AS signal, {rs('range_vol_21', 'iv_atm_pct', 'close')}, {r(f'1000 / (2 * close * (exp(-{d1} * {d1} / 2) / {SQRT_2PI!r}) * sqrt(t) * 0.01)', 'n_straddles')}
            FROM (SELECT *, 21 / 365.0 AS t, iv_atm_pct / 100 AS sigma FROM (SELECT * FROM vol21 WHERE range_vol_21 IS NOT NULL {newest.format(t='date')}) JOIN
            (SELECT series_id, refdate, iv_atm_pct FROM atm21 {newest.format(t='refdate')}) USING (series_id) JOIN
            (SELECT series_id, date AS spot_date, close FROM prices {newest.format(t='date')}) USING (series_id))"""
    )
    q["official_signal_today"] = build(
        f"""SELECT series_id, date, refdate, spot_date, CASE WHEN range_vol_21 - iv_atm_pct > 1 THEN 1 WHEN range_vol_21 - iv_atm_pct < -1 THEN -1 ELSE 0 END
            AS signal, {rs('range_vol_21', 'iv_atm_pct', 'close')}, {r(f'1000 / (2 * close * (exp(-{d1} * {d1} / 2) / {SQRT_2PI!r}) * sqrt(t) * 0.01)', 'n_straddles')}
            FROM (SELECT *, 21 / 365.0 AS t, iv_atm_pct / 100 AS sigma FROM (SELECT * FROM vol21 WHERE range_vol_21 IS NOT NULL {newest.format(t='date')}) JOIN
            (SELECT series_id, refdate, iv_atm_pct FROM atm21 {newest.format(t='refdate')}) USING (series_id) CROSS JOIN
            (SELECT date AS spot_date, pi_expectation AS close FROM survey ORDER BY date DESC LIMIT 1))"""
    )
    layered = ablation_ctes("ds_news", "steps", HAR + ["news"])
    q["layer_trade_summary"] = build(
        f"SELECT series_id, config, band_pct, {shown} FROM grid LEFT JOIN summary USING (series_id, config, band_pct)",
        grid="SELECT DISTINCT series_id, config, CAST(1 AS DOUBLE) AS band_pct FROM ds_news, (VALUES ('base'), ('layer')) c(config)",
        summary=summary, layer_fc="SELECT series_id, config, date, pred AS rv_forecast FROM preds",
        **layered, **trades("layer_fc", (1.0,)),
    )
    attentive = ablation_ctes("ds_attention_level", "steps", HAR + ["news"])
    q["attention_trade_summary"] = build(
        f"SELECT series_id, config, band_pct, {shown} FROM grid LEFT JOIN summary USING (series_id, config, band_pct)",
        grid="SELECT DISTINCT series_id, config, CAST(1 AS DOUBLE) AS band_pct FROM ds_attention_level, (VALUES ('base'), ('layer')) c(config)",
        summary=summary, layer_fc="SELECT series_id, config, date, pred AS rv_forecast FROM preds",
        **attentive, **trades("layer_fc", (1.0,)),
    )
    y = "CASE WHEN target > 0 THEN ln(target) END"
    weights = folds("ds_fiscal", "steps")
    for f in ("fiscal_surprise", "fiscal_sentiment"):
        weights |= regression(f"reg_{f}", "ds_fiscal", [x for x in DATASETS["fiscal"][0] if x != f] + [f], y)
    union = " UNION ALL ".join(
        f"SELECT series_id, '{f}' AS feature, fold, any_value(b_last) AS b FROM reg_{f} GROUP BY ALL" for f in ("fiscal_surprise", "fiscal_sentiment")
    )
    q["layer_weights"] = build(
        f"""SELECT series_id, feature, {r('avg(b)', 'coef_mean')}, {r('stddev_pop(b)', 'coef_sd')}, count(*) AS n_folds FROM each GROUP BY ALL""",
        each=union, **weights,
    )
    return q


def _diagnostics() -> dict[str, str]:
    q: dict[str, str] = {}
    lags = (1, 2, 3, 5, 10, 15, 21)
    q["acf"] = build(
        " UNION ALL ".join(f"SELECT series_id, CAST({k} AS INTEGER) AS lag, {r(f'corr(variance, l{k})', 'acf')} FROM lagged GROUP BY 1" for k in lags),
        lagged="SELECT series_id, variance, " + ", ".join(f"lag(variance, {k}) OVER {P} AS l{k}" for k in lags) + " FROM varied",
    )
    q["bar_quality"] = build(
        f"""SELECT series_id, {r('avg(abs(close - open))', 'mean_intra')}, {r('avg(gap)', 'mean_gap')}, {r('corr(open, close)', 'corr_open_close')},
            {r('avg(gap) / avg(abs(close - open))', 'gap_ratio')} FROM (SELECT *, abs(open - lag(close) OVER {P}) AS gap FROM bars) GROUP BY 1"""
    )
    by_rate = "OVER (PARTITION BY rate ORDER BY date)"
    shifts = {-1: f"lead(o, 1) {by_rate}", 0: "o", 1: f"lag(o, 1) {by_rate}"}
    q["lead_lag_corr"] = build(
        " UNION ALL ".join(
            f"SELECT p.series_id, rate, CAST({k} AS INTEGER) AS shift, {r('corr(ret, x)', 'r')} FROM price_ret p JOIN (SELECT date, rate, {s} AS x FROM o_ret) USING (date) GROUP BY 1, 2"
            for k, s in shifts.items()
        ),
        o_ret="SELECT date, series_id AS rate, ln(value) - lag(ln(value)) OVER (PARTITION BY series_id ORDER BY date) AS o FROM official",
    )
    q["volatility_profile"] = build(
        f"""SELECT series_id, {r('avg(range_vol_21)', 'mean')}, {r('max(range_vol_21)', 'max')}, {r('min(range_vol_21)', 'min')},
            count(range_vol_21) AS n FROM vol21 GROUP BY 1"""
    )
    q["volatility_correlation"] = build(
        f"SELECT series_id, {r('corr(a, b)', 'r')}, count(*) AS n FROM (SELECT series_id, range_vol_21 AS a, rv AS b FROM vol21 JOIN rv21 USING (series_id, date)) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1",
        rv21=f"SELECT series_id, date, (CASE WHEN count(ret) OVER {rows(21)} >= 21 THEN stddev_samp(ret) OVER {rows(21)} END) * sqrt(252) * 100 AS rv FROM price_ret",
    )

    def student(rr: str, n: str) -> str:
        """Two-sided p of a correlation: the closed series for integer degrees of freedom n − 2."""
        c2, th = f"(1 - {rr} * {rr})", f"asin(abs({rr}))"
        even = f"""abs({rr}) * list_sum(list_transform(range(0, ({n} - 2) // 2), lambda i: exp(lgamma(i + 0.5) - lgamma(0.5) - lgamma(i + 1))
            * pow({c2}, i)))"""
        odd = f"""2 / pi() * ({th} + abs({rr}) * sqrt({c2}) * coalesce(list_sum(list_transform(range(0, ({n} - 3) // 2), lambda i:
            exp(lgamma(i + 1) + lgamma(1.5) - lgamma(i + 1.5)) * pow({c2}, i))), 0))"""
        return f"1 - CASE WHEN {n} % 2 = 0 THEN {even} ELSE {odd} END"

    def skewed(h: int) -> str:
        w = rows(0, h)
        n, s1, s2, s3 = (f"{f} OVER {w}" for f in ("count(ret)", "sum(ret)", "sum(ret * ret)", "sum(ret * ret * ret)"))
        m = f"(({s1}) / ({n}))"
        value = f"""sqrt(({n}) * (({n}) - 1.0)) / (({n}) - 2) * (({s3}) / ({n}) - 3 * {m} * ({s2}) / ({n}) + 2 * {m} * {m} * {m})
            / pow(({s2}) / ({n}) - {m} * {m}, 1.5)"""
        return f"SELECT series_id, date, {h} AS horizon, CASE WHEN count(*) OVER {w} = {h} AND {n} >= {max(3, h - 3)} THEN {value} END AS skew FROM price_ret"

    q["skew_theta"] = build(
        f"""SELECT series_id, CAST(horizon AS INTEGER) AS horizon, {r('skew_mean')}, n_overlapping, {r('r_overlapping')}, n_independent, {r('r_independent')},
            {r(student('r_overlapping', 'n_overlapping'), 'p_overlapping')}, {r(student('r_independent', 'n_independent'), 'p_independent')} FROM (
            SELECT series_id, horizon, avg(skew) AS skew_mean, count(*) AS n_overlapping, corr(theta, skew) AS r_overlapping,
            count(*) FILTER (WHERE rn % horizon = 0) AS n_independent, corr(theta, skew) FILTER (WHERE rn % horizon = 0) AS r_independent
            FROM (SELECT *, row_number() OVER (PARTITION BY series_id, horizon ORDER BY date) - 1 AS rn FROM (SELECT s.*, x.theta_baseline AS theta FROM sk s
            ASOF LEFT JOIN anchored x ON s.date >= x.date) WHERE skew IS NOT NULL AND theta IS NOT NULL) GROUP BY ALL)""",
        sk=" UNION ALL ".join(skewed(h) for h in (10, 21, 42)),
    )
    return q


def _sources() -> dict[str, str]:
    q: dict[str, str] = {}
    q["source_official_rate"] = build("SELECT date, CAST(CAST(value AS DECIMAL(18, 4)) AS DOUBLE) AS value, series_id AS tipo FROM official")
    hourly = """SELECT * FROM (SELECT event_type AS query, date_trunc('hour', ts) AS date, count(*) AS n FROM events GROUP BY ALL)
        JOIN (SELECT date_trunc('hour', ts) AS date, count(*) AS total FROM events GROUP BY ALL) USING (date)"""
    q["source_news_volume"] = f"""SELECT query, CAST(date AS TIMESTAMP) AS date, n AS article_count, CAST(total AS BIGINT) AS total_monitored,
        {r('n / total * 100', 'share_pct')} FROM ({hourly})"""
    q["source_news_tone"] = f"""SELECT query, CAST(date AS TIMESTAMP) AS date, CAST(date - INTERVAL 3 HOUR AS DATE) AS local_day, CAST(n AS DOUBLE) AS tone
        FROM ({hourly})"""
    q["source_headlines"] = build(
        """SELECT CAST(date AS TIMESTAMP) + INTERVAL 12 HOUR AS date, title, 'u/' || (doc_id % 20 + 20 * (doc_id // 60)) AS url, query || '.example' AS domain, language,
            upper(language) AS sourcecountry, query FROM headlines QUALIFY row_number() OVER (PARTITION BY query, doc_id % 20 + 20 * (doc_id // 60)
            ORDER BY date DESC, language DESC, title DESC) = 1"""
    )
    day = f"CAST(DATE '{FIRST_DAY}' + CAST(page_id % {HEADLINE_DAYS} AS INTEGER) AS DATE)"
    q["source_meetings"] = f"""SELECT CAST(page_id AS INTEGER) AS nro_reuniao, CASE WHEN page_id % 2 = 0 THEN 'ata' ELSE 'comunicado' END AS tipo,
        {day} AS data_referencia, url AS titulo, {page_text()} AS texto, CASE WHEN page_id % 2 = 0 THEN url END AS url_pdf FROM pages"""
    q["source_meeting_numbers"] = "SELECT DISTINCT CAST(page_id AS INTEGER) AS nro_reuniao FROM pages"
    q["source_survey"] = """SELECT CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice) / 99991, 4) AS pi_expectation,
        round(avg(o_totalprice) / 99991, 2) AS pi_median, round(stddev_samp(o_totalprice) / 99991, 4) AS dispersion,
        CAST(count(*) AS INTEGER) AS n_respondentes FROM orders GROUP BY 1"""
    q["source_targets"] = build("SELECT CAST(year AS INTEGER) AS year, CAST(CAST(meta AS DECIMAL(18, 4)) AS DOUBLE) AS meta FROM meta")
    q["source_activity"] = """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS reference_date,
        CAST(CAST(date_trunc('month', o_orderdate) AS DATE) + 60 AS DATE) AS release_date, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL"""
    report = """SELECT date, 'DOL' || chr(65 + k % 26) || lpad(CAST(k AS VARCHAR), 2, '0') AS ticker, round(settlement * 1000, 3) AS settlement,
        round(open * 1000, 3) AS open, round(last * 1000, 3) AS last, round(low * 1000, 3) AS low, round(high * 1000, 3) AS high, open_interest,
        CAST(trades AS DOUBLE) AS trades FROM (SELECT *, CAST(regexp_extract(ticker, '([0-9]+)$', 1) AS INTEGER) AS k FROM contracts)
        WHERE k <= 20 AND k % 7 <> 0"""
    q["source_price_report"] = q["source_price_report_files"] = build(report)
    q["source_price_report_front"] = build(
        """SELECT date, ticker, settlement, coalesce(ticker <> lag(ticker) OVER (ORDER BY date), false) AS contract_changed FROM (
            SELECT * FROM report WHERE isodow(date) < 6 QUALIFY row_number() OVER (PARTITION BY date ORDER BY trades DESC, open_interest DESC, ticker DESC) = 1)""",
        report=report,
    )
    q["source_rss"] = f"""SELECT CASE WHEN page_id % 10 <> 0 THEN CAST({day} AS TIMESTAMP) + INTERVAL 1530 MINUTE END AS date, trim(url) AS title,
        CAST(page_id AS VARCHAR) AS link, CASE WHEN page_id % 7 <> 0 THEN {page_text()} ELSE '' END AS description,
        CAST(page_id % 3 AS VARCHAR) AS source FROM pages"""
    q["source_bars"] = build(
        f"SELECT date, {rs('open', 'high', 'low', 'close')} FROM (SELECT date, min(px) AS open, max(px) AS high, min(px) AS low, max(px) AS close FROM li GROUP BY 1)"
    )
    q["source_paired_closes"] = build(f"SELECT date, {rs('vix_close', 'dxy_close')} FROM risk")
    q["source_surface"] = build(
        f"""SELECT series_id, refdate, maturity_date, delta_pct, {r('iv_pct')} FROM surface WHERE NOT (delta_pct = 25 AND month(refdate) = 1)"""
    )
    for name, same in (("official", "official_rate"), ("volume", "news_volume"), ("headlines", "headlines"), ("meetings", "meetings"), ("rss", "rss"),
                       ("survey", "survey"), ("surface", "surface")):
        q[f"ingest_{name}"] = q[f"source_{same}"]
    q["ingest_tone"] = f"SELECT query, CAST(date AS TIMESTAMP) AS date, CAST(n AS DOUBLE) AS tone FROM ({hourly})"
    q["sink_table"] = build(f"SELECT date, {r('value')} FROM official WHERE series_id = '1-URGENT' AND date BETWEEN '1996-01-01' AND '1999-12-31'")
    q["stream_latest"] = """SELECT user_id, event_type, CAST(ts AS DATE) AS date, value, event_id FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS DATE) DESC, event_id DESC) = 1"""
    q["stream_daily_share"] = f"""SELECT CAST(ts AS DATE) AS date, count(*) FILTER (WHERE event_type = 'error') AS hits, count(*) AS total,
        {r("count(*) FILTER (WHERE event_type = 'error') / count(*) * 100", 'share_pct')} FROM events GROUP BY 1"""
    q["stream_first_arrivals"] = "SELECT DISTINCT user_id, event_type FROM events"
    return q
