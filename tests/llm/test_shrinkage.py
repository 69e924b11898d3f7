"""The shrinkage of sites' rates against the same sums in NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from collatrix.llm import site_quality as S


def strength(n, own, center):
    chance = (center * (1 - center) * n).sum() / n.sum()
    spread = (n * (own - center) ** 2).sum() - (len(n) - 1) * chance
    room = n.sum() - (n * n).sum() / n.sum()
    between = spread / room if room > 0 else 0
    return min(max(chance / between - 1, 2.0), 1e4) if between > 0 else 1e4


def logit(p):
    p = min(max(p, 1e-4), 1 - 1e-4)
    return np.log(p / (1 - p))


def test_rates_shrink_as_in_numpy(spark):
    rng = random.Random(6)
    docs = [(i, "x", f"h{rng.randrange(6)}", f"p{rng.randrange(3)}") for i in range(300)] + [(300, None, "lone", None), (301, "y", None, "p0")]
    labels = [(i, int(rng.random() < 0.3 + 0.1 * int(docs[i][2][1])), int(rng.random() < 0.2)) for i in range(0, 300, 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    # Without rows to fit on, a document's own evidence is zero, and one without a label counts as even.
    got = {r.doc_id: r for r in S.judge(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("source"), F.col("lang"), fit_rows=0).collect()}
    known = {i: (1 - q, t) for i, q, t in labels}
    for target, name in ((0, "p_quality"), (1, "p_toxic")):
        seen = {d[0]: float(known[d[0]][target]) if d[0] in known else 0.5 for d in docs}
        site = lambda d: (d[2], d[3])
        paths, hosts = {}, {}
        for d in docs:
            paths.setdefault(site(d), []).append(seen[d[0]])
            hosts.setdefault(d[2], []).append(seen[d[0]])
        whole = np.mean(list(seen.values()))
        rate = {h: np.mean(v) for h, v in hosts.items()}
        hold_host = strength(np.array([len(v) for v in hosts.values()], float), np.array(list(rate.values())), np.full(len(hosts), whole))
        hold_path = strength(np.array([len(v) for v in paths.values()], float), np.array([np.mean(v) for v in paths.values()]), np.array([rate[s[0]] for s in paths]))
        for d in docs:
            own, h, p = seen[d[0]], hosts[d[2]], paths[site(d)]
            host_rate = (sum(h) - own + hold_host * whole) / (len(h) - 1 + hold_host)
            path_rate = (sum(p) - own + hold_path * host_rate) / (len(p) - 1 + hold_path)
            posterior = 1 / (1 + np.exp(-(logit(path_rate) - logit(whole))))
            assert getattr(got[d[0]], name) == pytest.approx(1 - posterior if name == "p_quality" else posterior, abs=1e-9)


def test_long_labelled_texts_do_not_fit(spark):
    """A labelled text beyond the bound plays no part in the fit, and is judged like any other."""
    docs = spark.createDataFrame([(0, "long " * 400_000, "h", "p"), *((i, f"w{i} good" if i % 2 else f"w{i} bad", "h", "p") for i in range(1, 60))], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    sample = S.labelled_sample(docs, labels, 100, 1 << 20, "doc_id", "text")
    assert sample.count() == 59 and S.judge(docs, labels, F.col("source"), F.col("lang"), fit_bytes=1 << 20).count() == 60
