"""Spans, quality rules, secrets, URL verdicts and quotations against brute force."""

import collections
import hashlib
import math
import random
import re

import duckdb
import pandas as pd
import pytest

from skylane.llm import decision_lists, entropy_secrets, path_templates, quote_links, weak_pii
from skylane.llm.queries import RULES
from tests.compare import difference
from tests.conftest import SAMPLE
from tests.llm.samples import collected, edge_rows, empty, prose, table

# Personal data -----------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def base_spans(text):
    found = [(m.start(), k, m.end(), n) for k, (n, p, f) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if f(m[0])]
    return [(n, a, b) for a, _, b, n in sorted(found)]


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def numbers(seed):
    r = random.Random(seed)
    return "".join(r.choice("0123456789 -.+()@ab4111\n") for _ in range(400))


PII_ROWS = edge_rows() + [
    (30, "a@b.c_x@y.z 1.2.3.4.5.6.7.8 300.1.1.1 0001.002.3.255 +1 (974) 555-3436. é😀 call 4111-1111-1111-1111 or 41111111111111111111111"),
    (31, "a@b.c@d.e a@b-.c.. x@.y +12345678 +123456789 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6"),
    *[(40 + i, numbers(i)) for i in range(60)],
]


def test_base_spans_equal_plain_patterns(spark):
    found = collections.defaultdict(list)
    for r in weak_pii.scan(table(spark, PII_ROWS)).collect():
        found[r.doc_id].append(r)
    for key, text in PII_ROWS:
        spans = base_spans(text)
        expected = hashlib.sha256(shown(spans).encode()).hexdigest()
        rows = [r for r in found[key] if r.base_sha256 == expected]
        assert rows, (key, text)
        kinds = [k for k, _, _ in spans]
        assert [rows[0].n_email, rows[0].n_ip, rows[0].n_card, rows[0].n_phone] == [kinds.count(n) for n, _, _ in PATTERNS]
    assert weak_pii.scan(empty(spark)).collect() == []


def test_spans_of_one_start_follow_the_order_of_kinds(spark):
    rows = [(1, "+14155552671@sms.example.com"), (2, "192.168.0.1@host.com"), (3, "4111111111111111@x.org")]
    found = {r.doc_id: r for r in weak_pii.scan(table(spark, rows)).collect()}
    assert found[1].spans == "email:0:28,phone:0:12"
    for key, text in rows:
        spans = shown(base_spans(text))
        assert (found[key].spans, found[key].base_sha256) == (spans, hashlib.sha256(spans.encode()).hexdigest())


def test_patterns_stay_linear_on_hostile_text(spark):
    text = "a" * 50_000 + "@b.c" + " 1" * 15_000 + "1" * 50_000 + "a@" + "b." * 20_000 + "c +1 " + "(" * 30_000 + "2" + "1." * 30_000
    row = weak_pii.scan(table(spark, [(1, text)])).first()
    assert row.n_email == 2


def test_candidates_are_accepted_by_votes(spark):
    # Many well-formed accounts with passing checksums and some strings of the same form without.
    good = ["DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606"]
    rows = [(i, f"please transfer to account {good[i % 3]} today") for i in range(60)]
    rows += [(100 + i, f"part XX{i:02d}ABCD1234EFGH5678 in the list") for i in range(20)]
    rows += [(200, "nothing here"), (201, "mail x@y.com")]
    found = {r.doc_id: r for r in weak_pii.scan(table(spark, rows)).collect()}
    assert all(found[i].spans.startswith("iban:27:") for i in range(60))
    assert all(found[100 + i].spans == "" for i in range(20))
    assert found[201].spans == "email:5:12" and found[200].spans == ""


def test_em_finds_reliable_labelers():
    r = random.Random(8)
    counts = collections.Counter()
    truth = {}
    for _ in range(20_000):
        true = r.random() < 0.6
        votes = "".join("1" if (r.random() < right) == true else "0" for right in (0.95, 0.9, 0.7, 0.85))
        counts["k", votes] += 1
        truth.setdefault(("k", votes), []).append(true)
    belief = weak_pii.estimate([(k, v, n) for (k, v), n in sorted(counts.items())])
    classifier = weak_pii.train([(k, v, n) for (k, v), n in sorted(counts.items())])
    right = sum(((belief[p] > 0.5) == t) + ((classifier.score(*p) > 0) == t) for p, ts in truth.items() for t in ts)
    assert right / 40_000 > 0.93
    assert classifier.weights[0] > classifier.weights[2]


# Quality -----------------------------------------------------------------------------------------


def brute_statistics(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


QUALITY_ROWS = edge_rows() + [
    (50, "a b c d e f g h i\n" * 3 + "x\n\n \nx\n"),
    (51, "a " * 9),
    (52, " ".join(map(str, range(30))) + " # $ <b>"),
    (53, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 0 2 3 4 5 6 7 8 9"),
]


def test_statistics_equal_brute_force(spark):
    found = decision_lists.judge(table(spark, QUALITY_ROWS), decision_lists.DecisionList(()))
    expected = [(k, *brute_statistics(t), not brute_statistics(t)[-1]) for k, t in QUALITY_ROWS]
    assert collected(found) == sorted(expected, key=repr)
    assert decision_lists.judge(empty(spark), decision_lists.DecisionList(())).collect() == []


def labelled(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        text, bad = prose(i, r.randint(30, 60)), i % 4 == 0
        if bad:
            text = " ".join(w + ("***" if r.random() < 0.6 else "") for w in text.split())
        rows.append((i, text + (" R&D" if i % 5 == 0 else "")))
        labels.append((i, int(not bad), 0))
    labels += [(1, 0, 0), (None, 0, 0), (9_999, 0, 0), (2, None, 0)]
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: i % 4 != 0 for i in range(600)}


def test_learned_list_separates_and_keeps_clean_documents(spark):
    docs, labels, good = labelled(spark)
    rules = decision_lists.fit(decision_lists.training_rows(docs, labels))
    assert rules.rules
    kept = {r.doc_id: r.kept for r in decision_lists.judge(docs, rules).collect()}
    assert kept == good
    stage = decision_lists.only_kept(docs, rules)
    assert stage.columns == docs.columns
    assert {r.doc_id for r in stage.select("doc_id").collect()} == {i for i, g in good.items() if g}


def test_no_labels_keep_what_passes_the_limits(spark):
    docs = table(spark, QUALITY_ROWS)
    rules = decision_lists.fit(decision_lists.training_rows(docs, empty(spark, "doc_id long, quality int, toxic int")))
    assert rules.rules == ()
    assert all(r.kept != r.base_failed for r in decision_lists.judge(docs, rules).collect())


# Secrets -----------------------------------------------------------------------------------------

SECRET_PATTERNS = [
    ("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
]


def secret_base(text):
    found = [
        (m.start(), k, m.end(), n) for k, (n, p, least, g) in enumerate(SECRET_PATTERNS) for m in re.finditer(p, text or "") if len(m[g]) >= least
    ]
    return [(n, a, b) for a, _, b, n in sorted(found)]


def codes(seed):
    r = random.Random(seed)
    parts = ["token=", "PassWord : ", "api_key='", "apikey\": \"", "AKIA", "abcdef0123456789", "ſecret=abcdefgh", " ", "\n", "é", "ABC123", "x" * 9, "--", "/"]
    return "".join(r.choice(parts) for _ in range(60))


def test_secret_base_spans_equal_plain_patterns(spark):
    rows = edge_rows() + [(100 + i, codes(i)) for i in range(150)]
    found = collections.defaultdict(list)
    for r in entropy_secrets.scan(table(spark, rows)).collect():
        found[r.doc_id].append(r)
    for key, text in rows:
        spans = secret_base(text)
        expected = hashlib.sha256(shown(spans).encode()).hexdigest()
        own = [r for r in found[key] if r.base_sha256 == expected]
        assert own, (key, text)
        assert [own[0].n_assign, own[0].n_access, own[0].n_hex] == [[k for k, _, _ in spans].count(n) for n, *_ in SECRET_PATTERNS]
        listed = own[0].spans.split(",") if own[0].spans else []
        assert set(shown([s]) for s in spans) <= set(listed)
    assert entropy_secrets.scan(empty(spark)).collect() == []


def entropy(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in collections.Counter(text).values())


def test_windows_equal_entropies_counted_anew():
    r = random.Random(2)
    letters, least = entropy_secrets.CLASSES["entropy_mixed"]
    for _ in range(60):
        text = "".join(r.choice("abcABC0123xyzXYZ+/ .é789") for _ in range(150))
        w = entropy_secrets.WINDOW
        hot = [i for i in range(len(text) - w + 1) if set(text[i : i + w]) <= letters and entropy(text[i : i + w]) >= least]
        merged = []
        for i in hot:
            if merged and i <= merged[-1][1]:
                merged[-1] = (merged[-1][0], i + w)
            else:
                merged.append((i, i + w))
        assert entropy_secrets.hot_windows(text, letters, least) == merged


def test_random_keys_are_found_and_harmless_strings_are_not():
    r = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(r.choice(letters) for _ in range(40)) for _ in range(200)]
    assert sum(bool(entropy_secrets.spans_of(f"use {k} now")[1]) for k in keys) >= 195
    harmless = ["f81d4fae-7dec-11d0-a765-00c04fd430c8", "schachchsschpfheitschverheiten", "9807915762804490123456", "abcdefghijklmnopqrstuvwxyz0123456789"]
    harmless += ["/usr/local/share/doc/python3/library", "zzzzzzzzzzzzzzzzzzzzzzzz1", "2024-01-02-2024-03-04-2024", prose(7, 300)]
    for text in harmless:
        assert entropy_secrets.spans_of(text) == ([], []), text


def test_keys_are_found_beside_harmless_text():
    key = "xK4bQ9mTzR2wLp7vGc3h"
    path = "/services/incoming/webhooks/marketing-department/european-customers/newsletter-campaign"
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = "schachchsschpfheitschverheitenundnochvielmehrbuchstabenohnetrennungdanach"
    assert entropy_secrets.spans_of(path) == entropy_secrets.spans_of(f"{path}/2024/v2") == ([], [])
    assert entropy_secrets.spans_of(f"{path}/{key}")[1] == [(len(path) + 1, len(path) + 1 + len(key), "entropy_mixed")]
    camel = "/getUserName/MarketingDepartment/europeanCustomers/NewsletterCampaigns/incomingWebhooks/"
    for text in (f"{path}/{key}", f"{key}{path}", f"{path}/{key}{path}", alphabet + key, key + "/" + alphabet, f"{path}-{key}_{alphabet}", words + key, key + words, camel + key):
        base, added = entropy_secrets.spans_of(text)
        at = text.index(key)
        assert base == [] and any(a <= at and at + len(key) <= b for a, b, _ in added), text
        assert key not in entropy_secrets.without(text) and "[SECRET]" in entropy_secrets.without(text)


def test_redaction_keeps_rows_and_clean_texts(spark):
    rows = [(1, "token = abcdef123456 tail", 25), (2, None, None), (3, "clean text", 10), (3, "clean text", 10), (4, "a" * 30 + " é " + "0f" * 15, 63)]
    docs = table(spark, rows, "doc_id long, text string, n_chars long")
    out = entropy_secrets.redact(docs)
    assert out.columns == docs.columns
    found = collected(out.select("doc_id", "text", "n_chars"))
    assert found == sorted([(1, "[SECRET] tail", 13), (2, None, None), (3, "clean text", 10), (3, "clean text", 10), (4, "[SECRET] é [SECRET]", 19)], key=repr)


# URLs --------------------------------------------------------------------------------------------


def brute_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for r in RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    return host, path, best and best.name, best and best.verdict


URLS = [None, "", "abc", "http://A.Net?x=/en/", "http://EXAMPLE.net/en/a://b", "x://y", "https://anet/", "://net/", "http://x.org/fr/1#/y", "a:///net/", "ftp://É.NET/é?"]


def test_rules_hosts_and_paths(spark):
    urls = URLS + [r.url for r in spark.read.parquet(f"{SAMPLE}/pages.parquet").collect()] + ["http://a.org/" + "z/" * 5_000]
    rows = list(enumerate(urls)) + [(None, "http://b.net/"), (0, None)]
    pages = table(spark, rows, "page_id long, url string")
    found = path_templates.judge(pages, RULES).collect()
    assert len(found) == len(rows)
    expected = sorted(((k, *brute_verdict(u)[:3]) for k, u in rows), key=repr)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in found), key=repr) == expected
    by_rule = {k: brute_verdict(u)[3] for k, u in rows[:-2]}
    assert all(r.verdict == by_rule[r.page_id] for r in found if r.rule and r.page_id)
    assert path_templates.judge(empty(spark, "page_id long, url string"), RULES).collect() == []


def test_deep_paths_keep_their_own_templates(spark):
    deep = "/a/b/c/d/e/f/g/h/i/j"
    rules = (path_templates.Rule("block", "deep.com", deep + "/bad"),)
    rows = [(i, f"http://deep.com{deep}/{'bad' if i % 2 else 'good'}/{'xyz'[i // 2 % 3]}page") for i in range(120)]
    rows += [(1_000, "http://deep.com/" + "/".join(f"s{i}" for i in range(5_000)))]
    found = {r.page_id: r for r in path_templates.judge(table(spark, rows, "page_id long, url string"), rules).collect()}
    assert {found[i].template for i in range(0, 120, 2)} == {f"{deep}/good/{k}page" for k in 'xyz'}
    assert {found[i].verdict for i in range(0, 120, 2)} == {"allow"} and {found[i].verdict for i in range(1, 120, 2)} == {"block"}
    assert found[1_000].template.count("/") == 5_000


def test_merging_gives_a_branch_without_labels_the_verdict_of_those_like_it(spark):
    rules = (path_templates.Rule("block", "x.com", "/spam1/"), path_templates.Rule("block", "x.com", "/spam2/"), path_templates.Rule("allow", "x.com", "/news/"))
    rows = []
    for branch in ("spam1", "spam2", "spam3", "spam4"):  # one shape; two are labelled, two are not
        rows += [f"http://x.com/{branch}/buy/{i}" for i in range(60)] + [f"http://x.com/{branch}/now" for _ in range(20)]
    rows += [f"http://x.com/news/{i}/story" for i in range(100)] + [f"http://x.com/about/{i}/story" for i in range(100)]
    rows += [f"http://x.com/skewed/buy/{i}" for i in range(20)] + ["http://x.com/skewed/now"] * 60  # same templates, another spread
    found = path_templates.judge(table(spark, list(enumerate(rows)), "page_id long, url string"), rules).collect()
    verdicts = {}
    for r in found:
        verdicts.setdefault(r.path.split("/")[1], set()).add(r.verdict)
    assert verdicts == {k: {"block"} for k in ("spam1", "spam2", "spam3", "spam4")} | {k: {"allow"} for k in ("news", "about", "skewed")}


def test_templates_generalise_and_reject(spark):
    rules = (path_templates.Rule("block", "bad.com", "/shop/a"),)
    # Paths below /shop differ in every page; most are blocked by the rule, the others look the same.
    rows = [(i, f"http://bad.com/shop/a{i:03d}x/p") for i in range(200)] + [(1_000 + i, f"http://bad.com/shop/b{i}x/p") for i in range(10)]
    rows += [(2_000 + i, f"http://good.com/shop/b{i}x/p") for i in range(200)] + [(3_000, "http://bad.com/about")]
    found = {r.page_id: r for r in path_templates.judge(table(spark, rows, "page_id long, url string"), rules).collect()}
    assert {found[i].template for i in range(200)} == {"/shop/*/p"}
    assert {found[1_000 + i].verdict for i in range(10)} == {"block"}
    assert {found[2_000 + i].verdict for i in range(200)} == {"allow"}


# Quotations --------------------------------------------------------------------------------------

MESSAGES = [
    (1, 0, "user", "Hello there.\nHow are you?"),
    (1, 1, "assistant", "> How are you?\nFine!\n\nAnd you?"),
    (1, 2, "user", "On Monday X wrote:\n>> how ARE you\n> Fine!\nGood."),
    (1, 3, "user", "> Hello there.\n> How are you?\nLate reply > not quote"),
    (2, 0, "user", "a"),
    (2, 2, "user", "b"),
    (3, 0, "user", None),
    (3, 1, "user", "> nothing known"),
    (3, 2, "user", ">"),
    (3, 3, "user", ">>> x"),
    (4, 5, None, "> \n\n> a\n> a"),
    *[(5, i, "user", "same words" if i % 3 else f"> same words\nno {i}") for i in range(60)],
]


def test_quotations_equal_sql(spark):
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(MESSAGES, columns=["conv_id", "turn", "role", "text"]))
    found = quote_links.conversations(table(spark, MESSAGES, "conv_id long, turn long, role string, text string"))
    assert difference(found, con, quote_links.SQL) is None


def test_messages_without_keys_and_repeats(spark):
    rows = [(None, 1, "user", "> x"), (1, None, "user", "y"), (1, 0, "user", "z"), (1, 0, "user", "z"), (1, 1, "user", "> z\nw")]
    found = quote_links.conversations(table(spark, rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == 5
    assert {(r.conv_id, r.turn, r.reply_to) for r in found} == {(None, 1, None), (1, None, None), (1, 0, None), (1, 1, 0)}
    assert quote_links.conversations(empty(spark, "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("length", [1, 2, 70])
def test_long_chains(spark, length):
    rows = [(1, i, "user", f"m{i}") for i in range(length)]
    found = quote_links.conversations(table(spark, rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.turn, r.root, r.depth) for r in found} == {(i, 0, i) for i in range(length)}
