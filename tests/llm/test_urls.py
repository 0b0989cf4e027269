import random
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from tenderweave.llm.urls import FEATURES, RULES, _vector, filtered, lexical, parts, rule_of, sampled, trained


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.COM/en/x", "https://www.example.com/en/1?a=b#c", "https://a.www.example.com/en/", "https://x.example.com/en",
    "https://com/", "https://com", "http://a.net/es/1", "http://a.net/fr/", "http://bnet/fr/", "http://a.org/en/7?x=1&y=2", "http://É.com/", "x://y://z.com/en/", "http://a.net?b=/es/", "http://a.net/es/://b.com/",
    "http://telecom/", "http://example.com/en/\nx",
]


def test_rules_and_parts(spark):
    many = URLS + [f"https://w{i}.example.{t}/{p}/{i}" for i in range(40) for t in ("com", "net", "org") for p in ("en", "es", "de")]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(many)], "page_id long, url string, host string, rule string")
    rows = {r.page_id: r for r in filtered(df).collect()}
    assert len(rows) == len(many)
    for i, u in enumerate(many):
        host, path, rule, said = brute(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        assert rows[i].verdict == (said or rows[i].model)
    decided = [r for r in rows.values() if r.rule]
    assert sum(r.verdict == r.model for r in decided) > 0.9 * len(decided)


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert sorted((r.page_id, r.verdict) for r in filtered(df).collect()) == [(1, "allow"), (1, "allow"), (2, "allow")]
    assert filtered(df.limit(0)).collect() == []


def test_trees_on_unseen_hosts_and_without_rules(spark):
    rng = random.Random(5)
    host = lambda: "".join(rng.choice(["an", "be", "th", "ing"]) for _ in range(3))
    urls = [f"http://{rng.choice(['', 'm.', 'www.'])}{host()}.example.{t}/{p}/{i}" for i in range(400) for t in ("com", "net", "org") for p in [rng.choice(["en", "es", "de", "fr"])]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rule, said = rule_of()
    rows = lexical(parts(df).withColumn("said", said)).where("said is not null").withColumn("label", (F.col("said") == "block").cast("double")).withColumn("held", F.crc32("host") % 4 == 0)
    model, known = trained(sampled(rows.where("not held"), 5000).cache())
    cells = {(r.label, r.prediction): r["count"] for r in model.transform(_vector().transform(rows.where("held").withColumns(known))).groupBy("label", "prediction").count().collect()}
    right = cells.get((0.0, 0.0), 0) + cells.get((1.0, 1.0), 0)
    assert right >= 0.95 * sum(cells.values()) > 0
    assert {r.verdict for r in filtered(df).where("rule is null").collect()} == {"allow", "block"}
    assert not any("blocked" in f or "said" in f for f in FEATURES)


def test_first_split_is_that_of_brute_force(spark):
    rng = random.Random(2)
    rows = [([float(rng.randrange(6)) for _ in range(3)],) for _ in range(80)]
    rows = [(x, float((x[1] > 2) != (rng.random() < 0.1))) for (x,) in rows]
    df = spark.createDataFrame(rows, "x array<double>, label double").select("label", *[F.col("x")[k].alias(f"x{k}") for k in range(3)])
    from pyspark.ml.feature import VectorAssembler

    model = GBTClassifier(maxIter=1, maxDepth=1, seed=1).fit(VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="features").transform(df))
    var = lambda ys: sum((y - sum(ys) / len(ys)) ** 2 for y in ys) if ys else 0.0
    best = min((var([y for x, y in rows if x[k] <= t]) + var([y for x, y in rows if x[k] > t]), k, t) for k in range(3) for t in range(6))
    split = re.search(r"feature (\d+) <= ([\d.]+)", model.trees[0].toDebugString)
    assert (int(split[1]), int(float(split[2]))) == best[1:]


def test_the_sample_has_no_copies(spark):
    df = spark.createDataFrame([(f"http://a{k % 30}.com/",) for k in range(3000)], "url string").repartition(7)
    got = [r.url for r in sampled(df, 10).collect()]
    assert len(got) == 10 == len(set(got)) and sampled(df, 100).count() == 30


def test_counts_and_trees_take_all_labelled_urls(spark, monkeypatch):
    from tenderweave.llm import urls as U

    def seen(taken):
        found.append((taken.count(), taken.select("url").distinct().count(), *trained(taken)))
        return found[-1][2:]

    found = []
    monkeypatch.setattr(U, "trained", seen)
    # 300 folders, more than were looked up before, and more URLs than the sample had; each twice
    many = [f"http://a{i % 7}.example.{('com', 'net')[i % 2]}/{('es' if i % 4 == 1 else 'f' + str(i // 2 % 300))}/{i}" for i in range(12000)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(many * 2)], "page_id long, url string")
    rows = U.filtered(df)
    labelled = [u for u in many if brute(u)[3]]
    (n, different, _, known), folder = found[0], {}
    assert n == different == len(labelled) > 5000
    for u in labelled:
        f = u.split("/")[3]
        folder[f] = folder.get(f, 0) + 1
    assert len(folder) > 256
    got = spark.createDataFrame([("com", f) for f in [*folder, "none"]], "suffix string, folder string").withColumns(known).collect()
    usual = sum((c / n) ** 2 for c in folder.values())
    assert all(abs(r.f_folder_share - (folder[r.folder] / n if r.folder in folder else usual)) < 1e-12 for r in got)
    assert rows.count() == len(many) * 2
