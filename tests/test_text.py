import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from volpanel.functions import text as X


def test_entities_in_columns_equal_the_html_table(spark):
    rng = random.Random(7)
    names = rng.sample(sorted(html5), 300)
    texts = [
        "", "no entity", "a & b && c &", "&amp;amp;", "&#65;&#x41;&#X41 &#0;&#x0;&#13;&#128;&#x9f;&#129;", "&#1114112; &#x110000; &#99999999999999999999; &#xFFFFFFFFFFFFFFFFFF;",
        "&#xD800; &#55296 &#1; &#11; &#127; &#xfdd0; &#xffff; &#x1fffe;", "&notit; &noti &not &notin; &copycopy &COPY;x &AMPx", "&#; &#x; &;", "&#000000000000065; &#x00000000041;",
        "&nosuchname; &ampamp", "caf&eacute &frac12; &bne; &lt&gt", "&amp\n&amp\t&lt<b>", "&" * 40, "&" + "x" * 50 + ";", "&nbsp;&middot;&euro;&#8364;", "&#x1F600; &#128512",
        *(f"x&{n}y {n} &{n};" for n in names),
        *("".join(rng.choice(["&", "#", "x", "amp", ";", "6", "lt", "not", " ", "é", "gt;"]) for _ in range(rng.randrange(2, 14))) for _ in range(400)),
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.unescaped(F.col("t")).alias("u"))
    got = {r.i: r.u for r in rows.collect()}
    wrong = {t: (got[i], html.unescape(t)) for i, t in enumerate(texts) if got[i] != html.unescape(t)}
    assert not wrong


def test_plain_text_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("<p>a&nbsp;&amp; b</p>",)], "t string").select(X.plain_text(F.col("t")).alias("t"))
    assert df.first().t == "a & b"
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
