"""DuckDB statements for the corpus queries that SQL can express."""

from __future__ import annotations

from volpanel.llm.mixing import MARGINS, Mix
from volpanel.llm.quality_rules import GROWTH, MASS, MIN_WORDS, MOST, PRIOR, RATIOS, REPEAT_PERCENT, SPREAD, WHOLE
from volpanel.llm.queries import LISTED_WORDS, URL_RULES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality() -> str:
    """Words and lines as rows; windows of five words that occur twice; quantiles of mixtures of counted buckets."""
    ratio_rows = " UNION ALL ".join(
        f"SELECT lang, source, '{r.name}' ratio, {r.part} / {r.whole}::DOUBLE x FROM based WHERE NOT base_failed AND {r.whole} > 0" for r in RATIOS
    )
    cuts = ", ".join(f"max(CASE WHEN ratio = '{r.name}' THEN q75 + {r.reach} * (q75 - q50) END) cut_{r.name}" for r in RATIOS)
    passes = " AND ".join(
        f"NOT coalesce(m.{r.part} > c.cut_{r.name} * m.{r.whole} + {SPREAD} * sqrt(c.cut_{r.name} * m.{r.whole} + 1), false)" for r in RATIOS
    )
    mass = f"(n * {MASS} // sum(n) OVER g)::BIGINT mass, least({MOST}, {WHOLE} * sum(n) OVER g // (sum(n) OVER g + {PRIOR}))::BIGINT share"
    return rf"""
    WITH told AS (SELECT row_number() OVER () rid, doc_id, lang, source, coalesce(text, '') t, {WORDS} w, string_split(coalesce(text, ''), chr(10)) l FROM documents),
    word AS (SELECT rid, unnest(w) x, generate_subscripts(w, 1) i FROM told),
    five AS (SELECT rid, i, [x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o] k, lead(x, 4) OVER o last FROM word WINDOW o AS (PARTITION BY rid ORDER BY i)),
    twice AS (SELECT rid, i FROM five WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
    hit AS (SELECT rid, count(DISTINCT i + o) n FROM twice, range(5) r(o) GROUP BY rid),
    line AS (SELECT rid, unnest(l) x FROM told),
    lines AS (SELECT rid, count(*) n, count(DISTINCT x) d FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
    measured AS (
        SELECT told.rid, doc_id, lang, source, len(w)::BIGINT n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT word_chars,
            length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, coalesce(lines.n - lines.d, 0)::BIGINT n_dup_lines,
            coalesce(hit.n, 0)::BIGINT n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT n_capitals, coalesce(lines.n, 0)::BIGINT n_lines
        FROM told LEFT JOIN hit USING (rid) LEFT JOIN lines USING (rid)),
    based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words base_failed FROM measured),
    entry AS ({ratio_rows}),
    sketch AS (SELECT lang, source, ratio, CASE WHEN x > 0 THEN floor(ln(x) / ln({GROWTH}))::INT END bucket, count(*) n FROM entry GROUP BY ALL),
    whole AS (SELECT ratio, bucket, {mass} FROM (SELECT ratio, bucket, sum(n) n FROM sketch GROUP BY ALL) WINDOW g AS (PARTITION BY ratio)),
    tongue AS (SELECT lang, ratio, bucket, {mass} FROM (SELECT lang, ratio, bucket, sum(n) n FROM sketch GROUP BY ALL) WINDOW g AS (PARTITION BY lang, ratio)),
    own AS (SELECT lang, source, ratio, bucket, {mass} FROM sketch WINDOW g AS (PARTITION BY lang, source, ratio)),
    spoken AS (
        SELECT lang, ratio, bucket, sum(m) m FROM (
            SELECT lang, ratio, bucket, mass * share m FROM tongue
            UNION ALL SELECT lang, ratio, whole.bucket, whole.mass * ({WHOLE} - l.share) FROM (SELECT DISTINCT lang, ratio, share FROM tongue) l JOIN whole USING (ratio))
        GROUP BY ALL),
    mixture AS (
        SELECT lang, source, ratio, bucket, sum(m) m FROM (
            SELECT lang, source, ratio, bucket, mass * share * {WHOLE} m FROM own
            UNION ALL SELECT o.lang, o.source, o.ratio, s.bucket, s.m * ({WHOLE} - o.share)
            FROM (SELECT DISTINCT lang, source, ratio, share FROM own) o JOIN spoken s ON o.ratio = s.ratio AND o.lang IS NOT DISTINCT FROM s.lang)
        GROUP BY ALL),
    ranked AS (
        SELECT lang, source, ratio, CASE WHEN bucket IS NULL THEN 0.0 ELSE 2 * pow({GROWTH}, bucket + 1) / ({GROWTH} + 1) END v,
            sum(m) OVER (PARTITION BY lang, source, ratio ORDER BY bucket NULLS FIRST) upto, sum(m) OVER (PARTITION BY lang, source, ratio) total
        FROM mixture),
    quartile AS (
        SELECT lang, source, ratio, min(CASE WHEN upto * 4 >= total * 2 THEN v END) q50, min(CASE WHEN upto * 4 >= total * 3 THEN v END) q75
        FROM ranked GROUP BY ALL),
    cuts AS (SELECT lang, source, {cuts} FROM quartile GROUP BY ALL)
    SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, NOT m.base_failed AND {passes} kept
    FROM based m LEFT JOIN cuts c ON m.lang IS NOT DISTINCT FROM c.lang AND m.source IS NOT DISTINCT FROM c.source
    """


def _urls() -> str:
    rules = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in URL_RULES)
    canonical = r"regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)$', '')"
    return rf"""
    WITH rules(action, rule_host, rule_path) AS (VALUES {rules}),
    rest AS (SELECT row_number() OVER () rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END r FROM pages),
    parts AS (SELECT rid, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path FROM rest),
    keyed AS (SELECT *, CASE WHEN host = '' THEN '' ELSE {canonical} END k FROM parts),
    listed AS (SELECT DISTINCT k FROM keyed WHERE regexp_matches(host, '{"|".join(LISTED_WORDS)}')),
    best AS (
        SELECT rid, action, rule_host || rule_path rule FROM keyed, rules
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rule_host || rule_path) DESC) = 1)
    SELECT page_id, host, path, rule, coalesce(action, CASE WHEN l.k IS NOT NULL AND l.k <> '' THEN 'block' ELSE 'allow' END) verdict, (l.k IS NOT NULL AND l.k <> '') listed
    FROM keyed LEFT JOIN best USING (rid) LEFT JOIN listed l USING (k)
    """


def _mixing() -> str:
    mix = Mix()
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in mix.topics) + f" ELSE '{mix.other}' END"
    steps, last = [], "c0"
    for sweep in range(mix.sweeps):
        for margin in MARGINS:
            name = f"c{sweep}_{margin}"
            steps.append(
                f"{name} AS (SELECT source, lang, topic, tokens, least(1.0, p * coalesce(t_{margin} / nullif(sum(tokens * p) OVER (PARTITION BY {margin}), 0), 1.0)) p, "
                f"t_source, t_lang, t_topic FROM {last})"
            )
            last = name
    wanted = ", ".join(
        f"t{margin} AS (SELECT {margin}, {mix.keep} * sum(sum(tokens)) OVER () * pow(sum(tokens), {e}) / nullif(sum(pow(sum(tokens), {e})) OVER (), 0) t_{margin} FROM cell GROUP BY {margin})"
        for margin, e in zip(MARGINS, mix.exponents)
    )
    joins = " ".join(f"LEFT JOIN t{m} ON cell.{m} IS NOT DISTINCT FROM t{m}.{m}" for m in MARGINS)
    digits = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(1) || coalesce(text, '')), 1, 12))::BIGINT"
    return f"""
    WITH told AS (SELECT doc_id, source, lang, {topic} topic, len({WORDS})::BIGINT n_tokens, {digits} / {16**12}.0::DOUBLE draw FROM documents),
    cell AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE tokens FROM told GROUP BY ALL),
    {wanted},
    c0 AS (SELECT cell.source, cell.lang, cell.topic, tokens, {mix.keep}::DOUBLE p, t_source, t_lang, t_topic FROM cell {joins}),
    {", ".join(steps)}
    SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(p, 9) probability, draw < p kept
    FROM told d LEFT JOIN {last} c ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND d.topic = c.topic
    """


def _repair() -> str:
    """crc32 from its polynomial; one recursion over the rows that keeps, per last role initial, the cheapest edits and the rows they give."""
    told = "coalesce({0}::VARCHAR, ' ')"
    visible = r"[^\x20\x09-\x0D]"
    return rf"""
    WITH RECURSIVE crc_table AS (
        SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) t),
    told AS (
        SELECT conv_id, turn, {told.format("role")} role, {told.format("text")} body,
            xor(list_reduce(list_concat([4294967295], list_transform(string_split({told.format("conv_id")} || ':' || {told.format("turn")}, ''), lambda ch: ascii(ch)::BIGINT)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 kind
        FROM conversations, crc_table),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(body, '[.!?]', '', 'g') ELSE body END AS body
        FROM told, range(2) twice(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
    numbered AS (
        SELECT *, substr(role, 1, 1) initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(body)) i,
            regexp_extract(body, '({visible})[\x20\x09-\x0D]*$', 1) tail
        FROM damaged),
    judged AS (
        SELECT *, CASE WHEN NOT regexp_matches(body, '{visible}') THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, body ORDER BY i) > 1 THEN 'duplicate'
            WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' END fault,
            lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial pair
        FROM numbered),
    counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (fault = 'blank') blank,
            count(*) FILTER (fault = 'duplicate') duplicate, count(*) FILTER (fault = 'truncated') truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) illegal, count(*) n
        FROM judged GROUP BY conv_id),
    legal(p, q) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
    named(q, name) AS (VALUES ('u', 'user'), ('a', 'assistant')),
    ins AS (
        SELECT DISTINCT p, p q, '' letters, []::VARCHAR[] made FROM (SELECT p FROM legal UNION ALL SELECT q FROM legal)
        UNION ALL SELECT p, q, 'I', [name || ':'] FROM legal JOIN named USING (q)
        UNION ALL SELECT l.p, m.q, 'II', [x.name || ':', y.name || ':'] FROM legal l JOIN named x ON x.q = l.q JOIN legal m ON m.p = l.q JOIN named y ON y.q = m.q),
    path AS (
        SELECT conv_id, 0::BIGINT i, '' p, 0::BIGINT cost, '' audit, []::VARCHAR[] made FROM counted
        UNION ALL
        SELECT conv_id, i, p, cost, audit, made FROM (
            SELECT path.conv_id, path.i + 1 i, e.q p, path.cost + 2 * length(ins.letters) + e.cost cost, path.audit || ins.letters || e.letter audit,
                list_concat(path.made, ins.made, e.made) made
            FROM path JOIN ins USING (p) JOIN (
                SELECT conv_id, j.i, l.p, l.p q, 3 cost, 'D' letter, []::VARCHAR[] made FROM judged j, (SELECT DISTINCT p FROM ins) l
                UNION ALL SELECT conv_id, j.i, l.p, l.q, CASE WHEN fault IS NULL THEN 0 ELSE 1 END, 'K', [role || ':' || body]
                    FROM judged j JOIN legal l ON l.q = j.initial WHERE fault IS NULL OR fault = 'truncated'
                UNION ALL SELECT conv_id, j.i, l.p, l.q, CASE WHEN fault IS NULL THEN 2 ELSE 3 END, 'R', [name || ':' || body]
                    FROM judged j, legal l JOIN named USING (q) WHERE fault IS NULL OR fault = 'truncated') e
                ON e.conv_id IS NOT DISTINCT FROM path.conv_id AND e.i = path.i + 1 AND e.p = ins.q)
        QUALIFY row_number() OVER (PARTITION BY conv_id, p ORDER BY cost, audit) = 1),
    ended AS (
        SELECT path.conv_id, path.cost + 2 * length(letters) cost, path.audit || letters audit, list_concat(path.made, ins.made) made
        FROM path JOIN counted c ON c.conv_id IS NOT DISTINCT FROM path.conv_id AND path.i = c.n JOIN ins USING (p) WHERE ins.q IN ('', 'a')
        QUALIFY row_number() OVER (PARTITION BY path.conv_id ORDER BY path.cost + 2 * length(letters), path.audit || letters) = 1)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT gaps, coalesce(blank, 0)::BIGINT blank, coalesce(duplicate, 0)::BIGINT duplicate, coalesce(truncated, 0)::BIGINT truncated,
        coalesce(illegal, 0)::BIGINT illegal, coalesce(e.cost, 0)::BIGINT AS cost, coalesce(audit, '') audit, sha256(coalesce(array_to_string(made, chr(10)), '')) repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
    """


def _negatives() -> str:
    """Every anchor against every row by whole-number inner products, then ranks."""
    return """
    WITH known AS (
        SELECT row_number() OVER () r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.r ar, a.vec_id anchor_id, a.label = b.label same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT score
        FROM known a, known b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
    near AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) slot FROM scored WHERE same QUALIFY slot <= 5),
    hard AS (
        SELECT near.anchor_id, near.vec_id positive_id, s.vec_id negative_id, near.score positive_score, s.score negative_score,
            row_number() OVER (PARTITION BY near.ar, slot ORDER BY s.score DESC, s.vec_id)::INT AS rank
        FROM near JOIN scored s ON s.ar = near.ar AND NOT s.same AND 80 * near.score <= 100 * s.score AND 100 * s.score <= 100 * near.score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 5
    """


def statements() -> dict[str, str]:
    return {
        "op4_quality_rules": _quality(), "op5_url_filter": _urls(), "op9_mixing": _mixing(), "op11_conversation_repair": _repair(),
        "op13_hard_negatives": _negatives(),
    }
