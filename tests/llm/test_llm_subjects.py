import numpy as np

from mnemolake.llm.subjects import _without_citations, _without_headers, clean_labels, composition, strip_names, subjects

STEMS = ("alm", "bren", "corv", "dalt", "ester", "fond", "gurn", "hask", "ilm", "jort")
AREAS = {a: [s + e for s in STEMS for e in ends] for a, ends in {"sport": ("goal", "league"), "energy": ("volt", "pipe"), "farming": ("crop", "herd")}.items()}
FILL = ["The hearing took place in spring.", "No further evidence was offered.", "The costs are borne by the party."]


def made():
    g = np.random.default_rng(0)
    docs, truth = [], {}
    names = sorted(AREAS)
    for i in range(240):
        own = [names[i % 3]] if i % 8 else [names[i % 3], names[(i + 1) % 3]]
        truth[i] = set(own)
        body = []
        for a in own:
            for _ in range(5):
                x, y = g.choice(AREAS[a], 2, replace=False)
                body.append(f"The parties argue about the {x} and the {y}.")
        body += list(g.choice(FILL, 6))
        other = names[(i + 2) % 3]
        body.append(f"The decision on the {AREAS[other][0]} (Rep 2015, 819) concerned a different question.")
        g.shuffle(body)
        docs.append((i, f"Court of Hask\nOskny Turbine Trust, Claimant,\nv.\nZim{i % 5}va, Defendant\n\n" + " ".join(body), "en", "Court of Hask", f"D-{i}", 0))
    docs += [(900, None, "en", None, None, 0), (901, " \n", "en", None, None, 0), (902, " ".join(FILL * 5), None, "Court of Hask", None, 0)]
    return docs, truth


def test_subjects(spark):
    docs, truth = made()
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, docket_no string, subject int")
    labels = spark.createDataFrame([(i, s.upper() if i % 2 else s[:-1]) for i, t in truth.items() if len(t) == 1 and i < 90 for s in t] + [(3, None), (None, "sport"), (5, "nonsense")], "doc_id bigint, subject string")
    areas = spark.createDataFrame([(a,) for a in AREAS], "subject string")
    found = subjects(d, labels, areas)
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert not {900, 901, 902} & set(got)
    right = sum(len(truth[i] & got.get(i, set())) for i in truth)
    assert right / sum(map(len, truth.values())) > 0.95 and right / sum(map(len, got.values())) > 0.95
    c = {r["subject"]: r["documents"] for r in composition(found, d).collect()}
    assert c[None] >= 3 and set(c) == {None, *AREAS}
    assert subjects(d.limit(0), labels, areas).count() == 0 and subjects(d, labels.limit(0), areas).count() == 0 and subjects(d, labels, areas.limit(0)).count() == 0


def test_cleaning(spark):
    assert _without_citations("One. The decision on X (Rep 2015, 8) was other. Two (a) here.").split() == "One. Two (a) here.".split()
    assert _without_headers("a\npage D-1 2\nb", "D-1") == "a\nb" and _without_headers("a", None) == "a"
    x = np.array([2 * 5 + 1, 2 * 6 + 1, 2 * 7, -1, 2 * 6 + 1, 2 * 7, 2 * 6 + 1, -1])
    name, court = np.zeros(10, bool), np.zeros(10, bool)
    name[5] = True
    keep = strip_names(x, np.zeros(len(x), int), 1, name, court)
    assert keep[:4].tolist() == [False, False, True, True]
    l = clean_labels(spark.createDataFrame([(1, " Sprt"), (1, "sport"), (2, "zzzzz")], "doc_id bigint, subject string"), ["sport", "energy"]).collect()
    assert [tuple(r) for r in l] == [(1, "sport")]


def test_copies_and_large_subject(spark):
    docs, truth = made()
    # half of the rows are copies of one text; every word of a subject of a third of the texts is above a quarter of them
    docs = [(i, t if t is None or i >= 900 else t.replace("almgoal", "golgol") + " The parties argue about the " + ("golgol." if "sport" in truth[i] else "gulgul."), *rest) for i, t, *rest in docs]
    source = next(i for i in truth if truth[i] == {"sport"} and i > 100)
    text = docs[source][1] + " Kilnworks ovens and kilnbricks were replaced by roofers."
    copies = [(1000 + i, text, "en", "Court of Hask", f"E-{i}", 0) for i in range(250)]
    d = spark.createDataFrame(docs + copies, "doc_id bigint, text string, lang string, source string, docket_no string, subject int")
    labels = spark.createDataFrame([(i, s) for i, t in truth.items() if len(t) == 1 and i < 90 for s in t], "doc_id bigint, subject string")
    got = {}
    for r in subjects(d, labels, spark.createDataFrame([(a,) for a in AREAS], "subject string")).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert all("sport" in got.get(i, set()) for i, *_ in copies)
    right = sum(len(truth[i] & got.get(i, set())) for i in truth)
    assert right / sum(map(len, truth.values())) > 0.95 and right / sum(len(got.get(i, set())) for i in truth) > 0.95


def test_small_language(spark):
    docs, _ = made()
    words = {"sport": "kelpo", "energy": "virta", "farming": "pelto"}
    other = [(2000 + i, "Oikeus\n\n" + " ".join(f"asia koskee {words[a]}{e} ja {words[a]}{f} seudulla." for e, f in (("na", "sta"), ("lla", "ksi"), ("sta", "lle"))), None, "Oikeus", f"F-{i}", 0) for i, a in enumerate(sorted(words) * 8)]
    truth = {2000 + i: a for i, a in enumerate(sorted(words) * 8)}
    d = spark.createDataFrame([(x[0], x[1], "en" if x[0] < 2000 else None, *x[3:]) for x in docs + other], "doc_id bigint, text string, lang string, source string, docket_no string, subject int")
    texts = [(2100 + i, t.replace("asia", f"asia{'abcdefgh'[i % 8]}"), "", s, n, 0) for i, (_, t, _, s, n, _) in enumerate(other)]
    truth |= {2100 + i: truth[2000 + i] for i in range(len(other))}
    d = d.unionByName(spark.createDataFrame([(a, b, None, c, e, f) for a, b, _, c, e, f in texts], d.schema))
    labels = spark.createDataFrame([(i, sorted(AREAS)[i % 3]) for i in range(90) if i % 8] + [(i, a) for i, a in truth.items() if i < 2012], "doc_id bigint, subject string")
    got = {r["doc_id"]: r["subject"] for r in subjects(d, labels, spark.createDataFrame([(a,) for a in AREAS], "subject string")).collect()}
    assert sum(got.get(i) == a for i, a in truth.items()) > 0.9 * len(truth)
