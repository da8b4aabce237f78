"""URL filter (operator 3): rules first, then a character language-model ratio.

A rule ``host/path`` fits its host and all subdomains where the url's path
starts with the rule's path; the longest fitting rule decides. Urls that a rule
accepts or rejects are the training text of two variable-order Markov models
over characters (contexts of 0 to ``order`` characters; each order's estimate
is smoothed by the next lower one, the lowest by a uniform one). A url without
a rule gets the difference of its two log-likelihoods, divided by its length.
The cut between allow and block is calibrated on labelled urls that the models
have not seen (page_id divisible by 5): the hundredth of the score with the
best balanced accuracy, and of equals the one nearest to zero, then the smaller.

All steps are DataFrame functions; the models are tables of n-gram counts that
grow with the urls, so they are joined by shuffles and never broadcast.

Defined results: a null url or one without ``://`` has empty host and path, no
rule, and is judged by the model as an empty text; a url that occurs often
counts as often; with no labelled url every score is 0 and the verdict allow;
repeated rows give a row each; an empty table gives no rows; characters other
than printable ASCII count as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest context, weight of the lower order, symbols (printable ASCII, other, end).
ORDER, WEIGHT, ALPHABET = 4, 2.0, 96
#: Hundredths of the score are counted between these bounds.
LEAST, MOST = -1000, 1000

Rule = tuple[str, str]


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host and path columns."""
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _fits(rule: str) -> Column:
    host, path = rule.split("/", 1)
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)


def _by_rule(rules: list[Rule], pick: int) -> Column:
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    return F.coalesce(*[F.when(_fits(r[1]), F.lit(r[pick])) for r in longest], F.lit(None).cast("string"))


def _grams(text: str, order: int) -> Column:
    """Every character of a text, with the ``order`` characters before it; \\x01
    stands before the text and \\x02 ends it."""
    padded = f"concat(repeat('\\u0001', {order}), regexp_replace({text}, '[^!-~]', '\\u007f'), '\\u0002')"
    return F.expr(f"transform(sequence(1, length({text}) + 1), i -> substring({padded}, i, {order + 1}))")


def markov_ratio(grams: DataFrame, order: int = ORDER, weight: float = WEIGHT) -> DataFrame:
    """gram and ratio (log of its last character's probability after the others
    among accepted urls over that among rejected ones) from counts (gram, accepted, rejected)."""
    lower = None
    for k in range(order + 1):
        counts = grams.groupBy(F.expr(f"right(gram, {k + 1})").alias("g")).agg(
            F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
        context = counts.groupBy(F.expr(f"left(g, {k})").alias("c")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        now = counts.hint("merge").join(context, F.expr(f"left(g, {k})") == F.col("c"))
        if lower is None:
            now = now.withColumns({"la": F.lit(1.0 / ALPHABET), "lr": F.lit(1.0 / ALPHABET)})
        else:
            now = now.hint("merge").join(lower.select(F.col("g").alias("s"), F.col("pa").alias("la"), F.col("pr").alias("lr")),
                           F.expr(f"right(g, {k})") == F.col("s"))
        lower = now.select("g", ((F.col("a") + weight * F.col("la")) / (F.col("ca") + weight)).alias("pa"),
                           ((F.col("r") + weight * F.col("lr")) / (F.col("cr") + weight)).alias("pr"))
    return lower.select(F.col("g").alias("gram"), (F.ln("pa") - F.ln("pr")).alias("ratio"))


def _calibrated(scored: DataFrame) -> DataFrame:
    """One row: ``cut``, from labelled rows (label, bin) at most MOST - LEAST + 1 different bins."""
    bins = scored.groupBy("bin").agg(F.sum(F.expr("int(label = 'allow')")).alias("a"),
                                     F.sum(F.expr("int(label = 'block')")).alias("r"))
    every = bins.agg(F.sort_array(F.collect_list(F.struct("bin", "a", "r"))).alias("b"))
    return every.select(F.expr("""coalesce(get(sort_array(transform(b, x -> struct(
        -(aggregate(b, 0L, (n, y) -> n + if(y.bin >= x.bin, y.a, 0L)) / greatest(1L, aggregate(b, 0L, (n, y) -> n + y.a))
          + aggregate(b, 0L, (n, y) -> n + if(y.bin < x.bin, y.r, 0L)) / greatest(1L, aggregate(b, 0L, (n, y) -> n + y.r))) AS loss,
        abs(x.bin) AS far, x.bin AS bin))), 0).bin, 0)""").alias("cut"))


def judge(pages: DataFrame, rules: list[Rule], order: int = ORDER, weight: float = WEIGHT) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. ``rules``: (allow or block, host/path)."""
    host, path = split_url()
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = stored(urls.withColumns({"rule": _by_rule(rules, 1), "label": _by_rule(rules, 0),
                                    "held": F.coalesce(F.col("page_id") % 5 == 0, F.lit(False))}), "urls")
    # equal texts are scored once; each counts as often as it occurs
    texts = urls.groupBy(F.concat("host", "path").alias("text")).agg(
        *[F.count(F.when((F.col("label") == kind) & ~F.col("held"), 1)).alias(name)
          for kind, name in (("allow", "accepted"), ("block", "rejected"))])
    spread = texts.select("text", "accepted", "rejected", F.explode(_grams("text", order)).alias("gram"))
    # counted once and read by every order of the models
    grams = stored(spread.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "url-grams")
    model = markov_ratio(grams, order, weight)
    scores = stored(spread.select("text", "gram").hint("merge").join(stored(model, "url-model"), "gram").groupBy("text")
                    .agg((F.sum("ratio") / F.count("*")).alias("score"))
                    .select("text", F.least(F.greatest(F.floor(F.round("score", 9) * 100), F.lit(LEAST)), F.lit(MOST))
                            .cast("int").alias("bin")), "url-scores")
    rated = urls.hint("merge").join(scores, F.concat("host", "path") == F.col("text"))
    cut = _calibrated(rated.where("held AND label IS NOT NULL").select("label", "bin")).first()["cut"]  # one number
    return rated.select("page_id", "host", "path", "rule", F.coalesce(
        "label", F.when(F.col("bin") >= cut, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"))


def oracle_sql(rules: list[Rule], order: int = ORDER, weight: float = WEIGHT) -> str:
    """The same in DuckDB SQL."""
    def fits(rule):
        host, path = rule.split("/", 1)
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest)
    label = " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in longest)

    def level(k):
        lower = f"JOIN p{k - 1} l ON l.g = right(n.g, {k})" if k else ""
        la, lr = ("l.pa", "l.pr") if k else (f"(1.0::DOUBLE / {ALPHABET})",) * 2
        left = f"left(n.g, {k})" if k else "''"
        own = f"left(g, {k})" if k else "''"
        return f"""n{k} AS (SELECT right(gram, {k + 1}) AS g, sum(a) AS a, sum(r) AS r FROM grams GROUP BY 1),
        c{k} AS (SELECT {own} AS c, sum(a) AS ca, sum(r) AS cr FROM n{k} GROUP BY 1),
        p{k} AS (SELECT n.g, (n.a + {weight} * {la}) / (c.ca + {weight}) AS pa, (n.r + {weight} * {lr}) / (c.cr + {weight}) AS pr
                 FROM n{k} n JOIN c{k} c ON c.c = {left} {lower})"""
    return f"""WITH parts AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
    urls AS (SELECT *, CASE {rule} END AS rule, CASE {label} END AS label, coalesce(page_id % 5 = 0, false) AS held,
                    host || path AS text FROM split),
    spread AS (SELECT text, label, held,
                      concat(repeat(chr(1), {order}), regexp_replace(text, '[^!-~]', chr(127), 'g'), chr(2)) AS padded,
                      unnest(range(1, length(text)::BIGINT + 2)) AS i FROM urls),
    grams AS (SELECT substr(padded, i, {order + 1}) AS gram, count(*) FILTER (label = 'allow' AND NOT held) AS a,
                     count(*) FILTER (label = 'block' AND NOT held) AS r FROM spread GROUP BY 1),
    {", ".join(level(k) for k in range(order + 1))},
    scores AS (SELECT text, avg(ln(pa) - ln(pr)) AS score FROM (SELECT DISTINCT text, padded, i FROM spread)
               JOIN p{order} ON g = substr(padded, i, {order + 1}) GROUP BY text),
    rated AS (SELECT urls.*, least(greatest(floor(round(score, 9) * 100), {LEAST}), {MOST})::INTEGER AS bin
              FROM urls JOIN scores USING (text)),
    bins AS (SELECT bin, count(*) FILTER (label = 'allow') AS a, count(*) FILTER (label = 'block') AS r
             FROM rated WHERE held AND label IS NOT NULL GROUP BY 1),
    cuts AS (SELECT x.bin, coalesce(sum(y.a) FILTER (y.bin >= x.bin), 0) / greatest(1, sum(y.a))
                    + coalesce(sum(y.r) FILTER (y.bin < x.bin), 0) / greatest(1, sum(y.r)) AS good
             FROM bins x, bins y GROUP BY 1),
    cut AS (SELECT coalesce((SELECT bin FROM cuts ORDER BY good DESC, abs(bin), bin LIMIT 1), 0) AS cut)
    SELECT page_id, host, path, rule, coalesce(label, CASE WHEN bin >= cut THEN 'allow' ELSE 'block' END) AS verdict
    FROM rated, cut"""
