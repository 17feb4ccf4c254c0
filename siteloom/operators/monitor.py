"""Scan runs of an estate of sites: medians, comparison with the run before, issues, verdicts, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CERT_DAYS, FLOOR, DROP, SPREAD, FEWEST_SAMPLES, STALE_DAYS = 21, 90, 8, 8, 3, 2
CATEGORIES = (("performance", "Performance"), ("accessibility", "Accessibility"), ("best_practices", "Best practices"), ("seo", "SEO"))


def sample_median(samples: DataFrame, metrics: list[str], by: list[str], spread_of: str, rounded: str | None = None) -> DataFrame:
    """Per run: the upper median of each metric, samples and spread of one metric.

    Values are counted first, so what a run's ranks go over are its different values. Nulls don't count; a run without any
    sample of a metric has null.
    """
    kinds, names = dict(samples.dtypes), list(dict.fromkeys([*metrics, spread_of]))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])
    counts = samples.select(*by, F.explode(rows).alias("x")).groupBy(*by, "x.metric", "x.value").agg(F.count("x.value").alias("n"))
    run = Window.partitionBy(*by, "metric")
    ranked = counts.withColumn("upto", F.sum("n").over(run.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(run))
    middle = ranked.groupBy(*by, "metric").agg(F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("value"))).alias("median"), F.max("all").alias("n"), (F.max("value") - F.min("value")).alias("spread"))
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    median = {m: of(m, "median").cast(kinds[m]) for m in metrics}
    if rounded:
        median[rounded] = F.round(median[rounded], 2)
    return middle.groupBy(*by).agg(*[c.alias(m) for m, c in median.items()], of(spread_of, "n").alias("samples"), of(spread_of, "spread").cast(kinds[spread_of]).alias("spread"))


def run_compare(runs: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """runs with `before`: a struct of the columns in the run before of the same key, null for the first."""
    return runs.withColumn("before", F.lag(F.struct(*columns)).over(Window.partitionBy(key).orderBy(at)))


def scan_issues(runs: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(domain, run_ts, ord, level, what) from runs with medians, each compared with the run before of its domain.

    runs: domain, run_ts, status, cert_days, cert_expires, dns, pages, performance, accessibility, best_practices,
    seo, samples, runs, spread. redirects: the result of redirect_check with run_ts.
    """
    kept = ["dns", "pages", *[c for c, _ in CATEGORIES]]
    rows = run_compare(runs, "domain", "run_ts", kept)
    s = lambda c: F.col(c).cast("string")
    was = lambda c: F.col("before")[c]
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    dns, dns_was = F.coalesce("dns", F.array().cast("array<string>")), F.coalesce(was("dns"), F.array().cast("array<string>"))
    measured = F.col("samples").isNotNull() & (F.col("samples") > 0)
    enough = measured & (F.col("samples") >= FEWEST_SAMPLES)
    rules: list[tuple[Column, str, Column]] = [
        (~F.col("status").eqNullSafe(F.lit(200)), "urgent", text("Home page returned ", F.when(F.col("status") > 0, s("status")).otherwise("no response"))),
        (F.col("cert_days").isNull(), "urgent", F.lit("Could not read the TLS certificate")),
        (F.col("cert_days") < CERT_DAYS, "urgent", text("Certificate expires in ", s("cert_days"), " days (", s("cert_expires"), ") and has not renewed")),
        (F.size(dns) == 0, "urgent", F.lit("No A record resolves for the domain")),
        ((F.size(dns) > 0) & (F.size(dns_was) > 0) & (dns != dns_was), "attention", text("DNS changed: ", F.array_join(dns_was, ", "), " → ", F.array_join(dns, ", "))),
        (F.col("pages").isNull(), "attention", F.lit("Sitemap could not be read")),
        ((was("pages") > 0) & (F.col("pages") < was("pages")), "attention", text("Pages dropped from ", was("pages").cast("string"), " to ", s("pages"))),
        ((was("pages") > 0) & (F.col("pages") > was("pages")), "note", text("Pages went up from ", was("pages").cast("string"), " to ", s("pages"))),
        (~F.coalesce(measured, F.lit(False)), "attention", F.lit("Lighthouse did not complete — this site was not measured")),
        (measured & (F.col("samples") < FEWEST_SAMPLES), "note", text("Only ", s("samples"), " of ", s("runs"), " Lighthouse runs completed — treat the scores as indicative")),
        (enough & (F.col("spread") >= SPREAD), "note", text("Performance ranged ", s("spread"), " points across ", s("samples"), " runs — the median below is soft")),
    ]
    for c, label in CATEGORIES:
        v, old = F.col(c), was(c)
        fell = (old > 0) & (old - v >= DROP)
        rules += [
            (enough & (v < FLOOR), "attention", text(f"{label} is ", s(c), " (median of ", s("samples"), ")")),
            (enough & (v >= FLOOR) & F.coalesce(fell, F.lit(False)), "attention", text(f"{label} fell ", old.cast("string"), " → ", s(c))),
            (enough & (v >= FLOOR) & (v < 100) & ~F.coalesce(fell, F.lit(False)), "note", text(f"{label} is ", s(c), ", not 100 (median of ", s("samples"), ")")),
        ]
    found = F.array(*[F.when(rule, F.struct(F.lit(i).alias("ord"), F.lit(level).alias("level"), what.alias("what"))) for i, (rule, level, what) in enumerate(rules)])
    out = rows.select("domain", "run_ts", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("domain", "run_ts", "i.*")
    if redirects is not None:
        broken = redirects.where("kind = 'none'").select(
            F.col("from_host").alias("domain"), "run_ts", F.lit(len(rules)).alias("ord"), F.lit("attention").alias("level"),
            text(F.col("note"), " no longer redirects to ", F.col("to_host"), " (status ", F.when(F.col("status") > 0, s("status")).otherwise("none"), ")").alias("what"))
        out = out.unionByName(broken)
    return out


def redirect_check(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """expected(from_host, to_host, note) with status and kind: server, in-page or none."""
    rows = expected.join(observed, "from_host", "left")
    target = F.regexp_replace(F.regexp_replace(F.coalesce("location", F.lit("")), "^https?://", ""), "/$", "")
    server = F.col("status").between(300, 399) & F.startswith(target, F.col("to_host"))
    inside = (F.col("status") == 200) & F.col("body").rlike("(?i)http-equiv=[\"']refresh[\"']") & F.contains("body", F.col("to_host"))
    return rows.withColumn("kind", F.when(server, "server").when(inside, "in-page").otherwise("none")).drop("body")


def issue_verdict(issues: DataFrame, by: list[str]) -> DataFrame:
    """Counts by level and bad, warn or ok."""
    counts = issues.groupBy(*by).agg(*[F.count_if(F.col("level") == lv).cast("bigint").alias(n) for lv, n in (("urgent", "urgent"), ("attention", "attention"), ("note", "notes"))])
    return counts.withColumn("verdict", F.when(F.col("urgent") > 0, "bad").when(F.col("attention") > 0, "warn").otherwise("ok"))


def snapshot_upsert(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Records of new replace those of old with the same key; the others stay as they were."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def annotate_issues(issues: DataFrame, notes: DataFrame) -> DataFrame:
    """issues(site, ord, what) with `detail`: a note of the site whose key the text contains, each note at its first issue only."""
    hit = issues.join(notes.withColumnRenamed("at", "site"), "site").where(F.contains("what", F.col("match")))
    first = hit.withColumn("nth", F.row_number().over(Window.partitionBy("site", "match").orderBy("ord"))).where("nth = 1")
    one = first.groupBy("site", "ord").agg(F.min_by("html", "match").alias("detail"))
    return issues.join(one, ["site", "ord"], "left")


def crawl_rollup(issues: DataFrame, findings: DataFrame, scan_ts: Column, crawl_ts: Column) -> DataFrame:
    """Severe findings join the issues as attention, with the age of the crawl in days and whether it is stale."""
    severe = findings.where("level = 'high'").select("site", F.lit("attention").alias("level"), "what")
    age = F.round((F.unix_timestamp(scan_ts) - F.unix_timestamp(crawl_ts)) / 86400).cast("bigint")
    return issues.select("site", "level", "what").unionByName(severe).withColumn("crawl_age_days", age).withColumn("stale", age >= STALE_DAYS)


def rank_buckets(ranks: DataFrame, rank: str) -> DataFrame:
    return ranks.withColumn("bucket", F.when(F.col(rank) <= 3, "good").when(F.col(rank) <= 10, "mid").otherwise("none"))


def open_at(instants: DataFrame, hours: DataFrame) -> DataFrame:
    """instants(site, ts, ...) with `open`: whether the site's hours(site, day, opens, closes) of that weekday hold the minute. Closes is exclusive.

    A weekday without hours, or closed, is not open. Hours are minutes after midnight; day is 0 for Monday.
    """
    minute = F.hour("ts") * 60 + F.minute("ts")
    rows = instants.withColumn("day", F.weekday("ts")).withColumn("_minute", minute)
    spans = hours.where("opens is not null and closes is not null").groupBy("site", "day").agg(F.collect_list(F.struct("opens", "closes")).alias("_spans"))
    inside = F.exists("_spans", lambda h: (h["opens"] <= F.col("_minute")) & (F.col("_minute") < h["closes"]))
    return rows.join(spans, ["site", "day"], "left").withColumn("open", F.coalesce(inside, F.lit(False))).drop("_spans", "_minute")


def aggregate_rating(reviews: DataFrame, by: str, rating: str, least: int = 2) -> DataFrame:
    """Mean rating with one decimal and count of rated reviews, where there are enough."""
    groups = reviews.where(F.col(rating).isNotNull()).groupBy(by).agg(F.avg(rating).alias("mean"), F.count("*").alias("reviews"))
    return groups.where(F.col("reviews") >= least).select(by, F.format_number(F.round("mean", 1), 1).alias("rating"), "reviews")
