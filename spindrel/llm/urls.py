"""URL filters: rules first, then a character language-model ratio (native).

Two smoothed variable-order Markov models, of accepted and of rejected URLs, are learned
from the URLs that the rules decide.  A character's probability after up to ``ORDER``
characters is interpolated from the longest context down to none (Witten-Bell): with c
occurrences of a context and t different characters after it, the context's own estimate
weighs c / (c + t).  A URL's score is the mean log-likelihood difference per character of
the whole URL, its scheme, query and fragment included.

The threshold is calibrated with models that leave a keyed quarter of the labelled URLs
out of their counts: the point between the two mean scores of that quarter, in proportion to
their spreads.  The URLs left open are then scored with models that count every labelled URL.

Only DataFrame operations are used.  The longest contexts are counted once and shorter ones
summed from those counts; scores are computed for distinct URLs, so a hot host or URL
costs its join back only.  A character's row holds the URL's number and no more of it, so
all sizes are linear in the URLs' lengths.

Defined results: a null url or one without ``://`` has an empty host and path, and the
latter is scored like any other; a null or empty URL, or any when one of the models has
nothing to learn from, scores 0 and is allowed when the threshold is at most 0 (it is 0
without held-out URLs of both kinds); of rules of equal length the first in code point order
wins; very long URLs are judged whole; repeated rows are judged each; other columns are
ignored; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.llm.common import materialize, table

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 3
HOLD = "0123"  # first hex digits of a URL's digest that hold it out for calibration
SYMBOLS = 128.0
PAD = "\u0001"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest fitting rule, its verdict), both null if none fits."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def grams(urls: DataFrame) -> DataFrame:
    """n, ruled, held, gram: for each character of ``url``, it and the ORDER characters before."""
    # characters as an array: to cut the i-th out of a string takes time in i
    spelt = F.concat(F.array_repeat(F.lit(PAD), ORDER), F.regexp_extract_all("url", F.lit("(?s)."), 0))
    each = urls.where(F.length("url") > 0).select("n", "ruled", "held", spelt.alias("c"))
    cut = F.transform(F.sequence(F.lit(1), F.size("c") - ORDER), lambda i: F.concat(*[F.get("c", i - 1 + k) for k in range(ORDER + 1)]))
    return each.select("n", "ruled", "held", F.explode(cut).alias("gram"))


#: Counted columns: what is accepted and rejected, among the URLs not held out and among all.
COUNTS = ("allow_fit", "block_fit", "allow_all", "block_all")


def log_ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, fit, all: log-likelihood differences of the grams of ``wanted``, from counts of grams."""
    model = wanted.select("gram", *[F.lit(1.0 / SYMBOLS).alias(f"p_{c}") for c in COUNTS])
    for order in range(ORDER + 1):
        own = F.right(F.col("gram"), F.lit(order + 1))
        tails = counts.groupBy(own.alias("tail")).agg(*[F.sum(c).alias(f"n_{c}") for c in COUNTS])
        contexts = tails.groupBy(F.left("tail", F.lit(order)).alias("context")).agg(
            *[F.sum(f"n_{c}").alias(f"c_{c}") for c in COUNTS], *[F.sum((F.col(f"n_{c}") > 0).cast("long")).alias(f"t_{c}") for c in COUNTS]
        )
        model = model.withColumn("tail", own).withColumn("context", F.left("tail", F.lit(order))).join(tails, "tail", "left").join(contexts, "context", "left")
        zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double")
        blend = lambda c: (
            F.when(zero(f"c_{c}") > 0, (zero(f"n_{c}") + zero(f"t_{c}") * F.col(f"p_{c}")) / (zero(f"c_{c}") + zero(f"t_{c}"))).otherwise(F.col(f"p_{c}"))
        )
        model = model.select("gram", *[blend(c).alias(f"p_{c}") for c in COUNTS])
    return model.select("gram", *[(F.ln(f"p_allow_{m}") - F.ln(f"p_block_{m}")).alias(m) for m in ("fit", "all")])


def judge(pages: DataFrame, *, id_col="page_id", url_col="url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.select("page_id", "url", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    urls = parts.where("url is not null").select("url", "ruled").distinct()
    urls = materialize(urls.select(F.monotonically_increasing_id().alias("n"), "url", "ruled", F.substring(F.md5("url"), 1, 1).isin(*HOLD).alias("held")))[0]
    hit = lambda v, more: F.sum(((F.col("ruled") == v) & more).cast("long"))
    fit, every = ~F.col("held"), F.lit(True)
    counted = grams(urls.where("ruled is not null")).groupBy("gram")
    counts = materialize(counted.agg(*[hit(c[:5], fit if c.endswith("fit") else every).alias(c) for c in COUNTS]))[0]
    # only what the rules leave open, and the labels held out, needs a score
    asked = materialize(grams(urls.where("ruled is null or held")).drop("held"))[0]
    ratios = materialize(log_ratios(counts, asked.select("gram").distinct()))[0]
    of = F.when(F.col("ruled").isNull(), F.col("all")).otherwise(F.col("fit"))
    scores = materialize(asked.join(ratios, "gram").groupBy("n", "ruled").agg(F.avg(of).alias("score")))[0]
    threshold = calibrate(scores)
    guess = F.when(F.col("score") >= threshold, "allow").otherwise("block").alias("guess")
    mine = scores.where("ruled is null").join(urls.select("n", "url"), "n").select("url", guess)
    default = "allow" if threshold <= 0 else "block"
    return parts.join(mine, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "guess", F.lit(default)).alias("verdict"))


def calibrate(scores: DataFrame) -> float:
    """The threshold from held-out labelled scores: one row of statistics."""
    at = lambda v: F.when(F.col("ruled") == v, F.col("score"))
    s = scores.agg(
        F.avg(at("allow")).alias("ma"), F.coalesce(F.stddev_pop(at("allow")), F.lit(0.0)).alias("sa"),
        F.avg(at("block")).alias("mb"), F.coalesce(F.stddev_pop(at("block")), F.lit(0.0)).alias("sb"),
    ).first()
    if s["ma"] is None or s["mb"] is None:
        return 0.0
    if s["sa"] + s["sb"] == 0:
        return (s["ma"] + s["mb"]) / 2
    return (s["ma"] * s["sb"] + s["mb"] * s["sa"]) / (s["sa"] + s["sb"])


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    """DuckDB text of ``op4_urls``; the same counts, blends and threshold."""

    def model(m: str, counts: str) -> str:
        """CTEs of the log ratios of one pair of models, from the grams of ``counts``."""
        out, before = [], "(SELECT gram, 1.0 / 128 AS pa, 1.0 / 128 AS pb FROM wanted)"
        for k in range(ORDER + 1):
            blend = lambda x: f"CASE WHEN c.c{x} > 0 THEN (coalesce(t.{x}, 0) + c.t{x} * m.p{x}) / (c.c{x} + c.t{x}) ELSE m.p{x} END AS p{x}"
            out += [
                f"{m}t{k} AS (SELECT right(gram, {k + 1}) AS tail, sum(a) AS a, sum(b) AS b FROM {counts} GROUP BY 1)",
                f"{m}c{k} AS (SELECT left(tail, {k}) AS context, sum(a) AS ca, sum(b) AS cb, sum((a > 0)::BIGINT)::DOUBLE AS ta, sum((b > 0)::BIGINT)::DOUBLE AS tb FROM {m}t{k} GROUP BY 1)",
                f"{m}{k} AS (SELECT m.gram, {blend('a')}, {blend('b')} FROM {before} m LEFT JOIN {m}t{k} t ON t.tail = right(m.gram, {k + 1}) LEFT JOIN {m}c{k} c ON c.context = left(right(m.gram, {k + 1}), {k}))",
            ]
            before = f"{m}{k}"
        return ", ".join(out)

    rest = "substr(url, strpos(url, '://') + 3)"
    return rf"""
WITH parts AS (
  SELECT page_id, url,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts),
urls AS (
  SELECT DISTINCT url, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled,
    left(md5(url), 1) IN ('0', '1', '2', '3') AS held
  FROM ruled WHERE url IS NOT NULL),
spelled AS (
  SELECT url, ruled, held, substr(repeat(chr(1), {ORDER}) || url, i, {ORDER + 1}) AS gram
  FROM (SELECT *, unnest(range(1, length(url) + 1)) AS i FROM urls WHERE length(url) > 0)),
every AS (SELECT gram, sum((ruled = 'allow')::BIGINT)::DOUBLE AS a, sum((ruled = 'block')::BIGINT)::DOUBLE AS b FROM spelled WHERE ruled IS NOT NULL GROUP BY gram),
fit AS (SELECT gram, sum((ruled = 'allow')::BIGINT)::DOUBLE AS a, sum((ruled = 'block')::BIGINT)::DOUBLE AS b FROM spelled WHERE ruled IS NOT NULL AND NOT held GROUP BY gram),
wanted AS (SELECT DISTINCT gram FROM spelled WHERE ruled IS NULL OR held),
{model("f", "fit")}, {model("e", "every")},
stats AS (
  SELECT avg(score) FILTER (ruled = 'allow') AS ma, coalesce(stddev_pop(score) FILTER (ruled = 'allow'), 0) AS sa,
    avg(score) FILTER (ruled = 'block') AS mb, coalesce(stddev_pop(score) FILTER (ruled = 'block'), 0) AS sb
  FROM (SELECT url, ruled, avg(ln(pa) - ln(pb)) AS score FROM spelled JOIN f{ORDER} USING (gram) WHERE ruled IS NOT NULL AND held GROUP BY url, ruled)),
threshold AS (
  SELECT CASE WHEN ma IS NULL OR mb IS NULL THEN 0 WHEN sa + sb = 0 THEN (ma + mb) / 2 ELSE (ma * sb + mb * sa) / (sa + sb) END AS t FROM stats),
scores AS (SELECT url, avg(ln(pa) - ln(pb)) AS score FROM spelled JOIN e{ORDER} USING (gram) WHERE ruled IS NULL GROUP BY url)
SELECT r.page_id, r.host, r.path, r.rule,
  CASE WHEN r.rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN r.rule IS NOT NULL THEN 'block'
    WHEN s.score IS NOT NULL THEN CASE WHEN s.score >= t THEN 'allow' ELSE 'block' END
    ELSE CASE WHEN t <= 0 THEN 'allow' ELSE 'block' END END AS verdict
FROM ruled r LEFT JOIN scores s ON s.url = r.url CROSS JOIN threshold
"""


ORACLE = _oracle()
