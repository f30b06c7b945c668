"""Secret scans, license scans and url filters."""

import base64
import hashlib
import os
import random
import re
import sys

sys.path.insert(0, os.path.dirname(__file__))

from awkward import LOWER, PASSAGE, SECRET, TEXTS, ascii_words, documents, empty, rows_of

from tidegauge.llm import licenses, secrets, urls

KINDS = [
    ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), lambda m: len(m.group(2)) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24),
]


def base_spans(text):
    found = [(m.start(), i, name, m.end()) for i, (name, r, ok) in enumerate(KINDS) for m in r.finditer(text or "") if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_secret_spans_match_brute_force(spark):
    docs = documents(spark)
    got = secrets.digest(secrets.scan(docs, keep=["doc_id", "text"]), keep=["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        want = base_spans(r["text"])
        # re.I in Python would fold the long s; the pattern's letters are ASCII
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (r["text"][:60], want, r["spans"])
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [want.count(k) for k in ("assign", "access", "hex")]


def test_widely_copied_candidates_are_examples(spark):
    rows = [(i, f"password={SECRET}q ", f"o{i}") for i in range(5)] + [(9, "token=Zx81kQp0Lm44Rt ", "o1"), (10, "ghp_0aB1cD2eF3gH4iJ5kL6m", "o1"), (11, "passwd=changeme123", "o2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["found"] for r in secrets.scan(docs, keep=["doc_id"], most_owners=2).collect()}
    assert [s["verdict"] for s in got[0]] == ["example"] and got[0][0]["n_owners"] == 5 == got[0][0]["n_repos"]
    assert [s["verdict"] for s in got[9]] == ["live"]
    assert [s["name"] for s in got[10]] == ["vendor", "opaque"]
    assert [s["verdict"] for s in got[11]] == ["weak"]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean[9] == "<secret> " and clean[0] == rows[0][1] and clean[11] == rows[7][1]


def pem(seed, end="\n", size=1600, kind="RSA "):
    body = base64.b64encode(b"".join(hashlib.sha256(f"{seed} {i}".encode()).digest() for i in range(60))).decode()[:size]
    return f"-----BEGIN {kind}PRIVATE KEY-----{end}" + end.join(body[i : i + 64] for i in range(0, size, 64)) + f"{end}-----END {kind}PRIVATE KEY-----"


def test_private_keys_are_reported_and_redacted(spark):
    keys = [pem(i) for i in range(4)]
    header = "-----BEGIN RSA PRIVATE KEY-----"
    # many owners have a private key each; only key 3 is everybody's, with other line ends here and there
    rows = [(i, f"one {keys[i]} two {keys[3]} end", f"o{i}") for i in range(3)]
    rows += [(3, f"a{pem(9, size=64, kind='')}b{pem(8, end=chr(92) + 'n', kind='EC ')}c", "o1"), (4, pem(3, end="\r\n"), "o4"), (5, f"{header} is how it begins", "o5"), (6, f"{header}\nyour key: 1 goes here, in lines of 64 characters each\n-----END RSA PRIVATE KEY-----", "o6")]
    rows += [(7, f"{header}\nDEK-Info: AES-128-CBC,{keys[0][:5]} -- {header}\n" * 300 + keys[0][32:], "o0"), (8, f"{header}\n" + "-a" * 50_000, "o8")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: [(s["start"], s["end"], s["n_owners"]) for s in r["found"] if s["name"] == "pem"] for r in secrets.scan(docs, keep=["doc_id"]).collect()}
    for i in range(3):
        assert found[i] == [(4, 4 + len(keys[i]), 1)]
    assert [e - s for s, e, _ in found[3]] == [len(pem(9, size=64, kind="")), len(pem(8, end="\\n", kind="EC "))]
    assert found[4] == found[5] == found[6] == found[8] == [] and len(found[7]) == 1
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert [clean[i] for i in range(3)] == [f"one <secret> two {keys[3]} end" for i in range(3)]
    assert clean[3] == "a<secret>b<secret>c" and all(clean[i] == rows[i][1] for i in (4, 5, 6, 8))


def test_redact_keeps_rows_columns_and_empty_tables(spark):
    docs = documents(spark)
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert sum(r["text"] is None for r in out.collect()) == 1
    assert secrets.redact(empty(spark)).count() == 0
    assert secrets.scan(empty(spark), keep=["doc_id"]).count() == 0


def test_license_places_match_brute_force(spark):
    docs = documents(spark)
    got = licenses.digest(licenses.scan(docs, keep=["doc_id", "text"]), keep=["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        w, places, labels = ascii_words(r["text"]), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert r["n_words"] == len(w)
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and set(labels) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    # a notice with a word put in lies on two neighbouring diagonals
    notice = [r for r in got if (r["text"] or "").startswith("permission")][0]
    assert notice["labels"] == "mit" and notice["base_labels"] == "" and notice["score"] > 0.8
    assert licenses.scan(empty(spark), keep=["doc_id"]).count() == 0


def test_shuffled_notice_is_no_license(spark):
    words = next(iter(licenses.NOTICES)).split()
    docs = spark.createDataFrame([(1, " ".join(words[::-1])), (2, " ".join(sorted(words)))], "doc_id long, text string")
    assert {r["labels"] for r in licenses.digest(licenses.scan(docs, keep=["doc_id"]), keep=["doc_id"]).collect()} == {""}


def test_a_notice_is_read_in_order_and_every_place_counts_once(spark):
    mit, gpl = (n.split() for n, label in licenses.NOTICES.items() if label in ("mit", "gpl"))
    half = len(mit) // 2
    texts = {
        1: "free of charge " * 6,
        2: "free of charge " * 400 + " ".join(mit),
        3: " ".join(mit[:5] + ["certainly"] + mit[5:9] + mit[10:]),
        4: " ".join(mit[half:] + mit[:half]),
        5: " ".join(mit + ["and", "then"] + mit),
        6: " ".join(w for i in range(0, len(gpl), 3) for w in reversed(gpl[i : i + 3])),
        7: " ".join(mit[:8]) + " free of charge " * 3 + " ".join(mit[:8]),
    }
    rows = [(i, t) for i, t in texts.items()] + [(3, texts[3])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).collect()
    found = {r["doc_id"]: [(s["first"], s["last"], s["label"]) for s in r["spans"] if not s["exact"]] for r in got}
    assert len(got) == 8 and found[1] == found[4] == found[6] == found[7] == []
    assert [s[2] for s in found[2]] == ["mit"] and found[2][0][1] == 1200 + len(mit) - 1
    assert found[3] == [(0, len(mit) - 1, "mit")]
    assert found[5] == [(0, len(mit) - 1, "mit"), (len(mit) + 2, 2 * len(mit) + 1, "mit")]


def test_chain_matches_brute_force(spark):
    rng = random.Random(5)
    for _ in range(12):
        hits = list({(rng.randrange(9), rng.randrange(14)) for _ in range(18)})
        best = {}
        for t, p in sorted(hits):
            best[t, p] = 1 + max([n for (a, b), n in best.items() if a < t and b < p], default=0)
        row = spark.createDataFrame([([(t, -p) for t, p in hits],)], "hits array<struct<tpos:int,back:long>>")
        assert row.select(licenses.chain(row["hits"])).first()[0] == max(best.values())


def test_a_value_in_many_repositories_of_one_owner_is_an_example(spark):
    many, few, copied = "q7Zp0Lm44RtXw81k", "b5Nc8Vy2Hs6Jd3Fg", "k9Ue3Wq7Ao1Il5Tz"
    rows = [(i, f"note {i} token={many}", "one") for i in range(20)] + [(100 + i, f"note {i} token={few}", "one") for i in range(3)]
    rows += [(200 + i, f"the same page with token={copied} in it", "one") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["found"][0] for r in secrets.scan(docs, keep=["doc_id"]).collect()}
    assert (got[0]["verdict"], got[0]["n_owners"], got[0]["n_repos"]) == ("example", 1, 20)
    assert got[100]["verdict"] == "live" and got[200]["verdict"] == "live"
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean[0] == rows[0][1] and clean[101] == "note 1 <secret>" and clean[219] == "the same page with <secret> in it"


def test_opaque_values_of_any_length(spark):
    long = "aBcdEfgh" * 11 + "xy" + "9" + "Zq"
    docs = spark.createDataFrame([(1, f"see {long} here", "a"), (2, "a-" * 200_000 + "B", "a"), (3, "x" * 300_000, "a")], "doc_id long, text string, source string")
    got = {r["doc_id"]: [(s["name"], s["start"], s["end"]) for s in r["found"]] for r in secrets.scan(docs, keep=["doc_id"]).collect()}
    assert got == {1: [("opaque", 4, 4 + len(long))], 2: [], 3: []}


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org/en/123", "http://example.org/EN/123", "http://org", "http://org/", "http://xorg/", "https://a.b.com/fr/", "https://a.b.com/de/q",
    "https://com/fr", "http://user@host.org:80/", "http://site.org/path", "http://q.net/spam-farm/1", "http://q.net/my-spamming", "http://q.net/?u=http://z.org/", "x://y://z.org/", "http://best-CASINO.net/a\nb", "http://example.org/es/casino",
]


def test_url_rules_match_brute_force(spark):
    rows = list(enumerate(URLS)) + [(4, URLS[4])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' AS host", "'t' AS token", "1 AS rank", "'x' AS pattern")
    got = urls.judge(pages, keep=["page_id", "url"]).collect()
    assert len(got) == len(rows)
    for r in got:
        u, host, path = r["url"], "", ""
        if u and "://" in u:
            host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
            host = host.translate(LOWER)
        fits = [s for s in urls.SITES if (h := s.name.split("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith("/" + s.name.partition("/")[2])]
        best = max(fits, key=lambda s: s.rank, default=None)
        spam = [w for w in urls.WORDS if re.search(w.pattern, (u or "").translate(LOWER))]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best.name), u
        assert r["verdict"] == (best.verdict if best else "block" if spam else "allow"), u
    assert urls.judge(pages.limit(0), keep=["page_id"]).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://example.org/en/{i}") for i in range(20)] + [(99, "http://example.org/es/")], "page_id long, url string")
    parsed = pages.select(urls.tokens_of(pages["url"], urls.host_of(pages["url"]), urls.path_of(pages["url"])).alias("tokens"))
    index = {r["name"]: (r["token"], r["urls"]) for r in urls.rule_index(parsed, list(urls.SITES)).collect()}
    assert index["example.org/es/"] == ("p:es", 1) and index["com/de/"][1] == 0 and index["org/"] == ("h:org", 21)


def test_long_texts_and_row_counts(spark):
    assert rows_of(documents(spark), "doc_id")[0] is not None and len(TEXTS) == 22 and PASSAGE
