import hashlib
import itertools
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leakguard.llm import repair, spelling, urls
from leakguard.llm.queries import QUERIES

# --- conversation repair -------------------------------------------------------------


def exhaustive(facts, most):
    """Cheapest (cost, audit) by trying all edits up to a cost."""
    best = None
    stack = [(0, "", "", 0)]
    while stack:
        at, roles, audit, cost = stack.pop()
        if cost > most or (best and cost > best[0]):
            continue
        if at == len(facts) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        for role in "ua":
            stack.append((at, roles + role, audit + "I", cost + 5))
        if at < len(facts):
            initial, fault = facts[at]
            stack.append((at + 1, roles, audit + "D", cost + 2))
            if fault not in "bd":
                late = 5 if fault == "t" else 0
                stack.append((at + 1, roles + (initial or "?"), audit + "K", cost + late))
                stack += [(at + 1, roles + role, audit + "R", cost + 1 + late) for role in "ua"]
    return best


FACT = st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.sampled_from("---tbd"))


@settings(max_examples=150, deadline=None)
@given(st.lists(FACT, max_size=5))
def test_edits_equal_exhaustive_search(facts):
    assert repair.best_edits(facts) == exhaustive(facts, 2 * len(facts) + 1)


def table_search(facts):
    """The same by a table over rows and places, for conversations of any length."""
    wanted = {0: "u", 1: "u", 2: "a", 3: "u"}
    then = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(row):
        out = dict(row)
        for place, (cost, audit) in row.items():
            for _ in range(3):
                place, cost, audit = then[place], cost + 5, audit + "I"
                out[place] = min(out.get(place, (cost, audit)), (cost, audit))
        return out

    row = {0: (0, "")}
    for initial, fault in facts:
        new: dict = {}
        for place, (cost, audit) in inserted(row).items():
            moves = [("D", 2, place)]
            if fault not in "bd":
                late = 5 if fault == "t" else 0
                moves.append(("R", 1 + late, then[place]))
                if initial == wanted[place]:
                    moves.append(("K", late, then[place]))
                if initial == "s" and place == 0:
                    moves.append(("K", late, 1))
            for letter, more, to in moves:
                value = (cost + more, audit + letter)
                new[to] = min(new.get(to, value), value)
        row = new
    return min(v for k, v in inserted(row).items() if k in (0, 3))


def test_long_conversations():
    rng = np.random.default_rng(11)
    for n in (30, 200, 3_000):
        facts = [(str(rng.choice(list("suax"))), str(rng.choice(list("---tbd")))) for _ in range(n)]
        assert repair.best_edits(facts) == table_search(facts)
    start = time.monotonic()
    turns = [("ua"[i % 2], "-" if i % 7 else "t") for i in range(100_000)]
    assert len(repair.best_edits(turns)[1]) >= len(turns) and time.monotonic() - start < 60


def test_audit_gives_the_repaired_rows():
    rows = [("assistant", "a."), ("system", "s."), ("user", "u."), ("user", "v.")]
    facts = [(r[0], "-") for r, _ in rows]
    cost, audit = repair.best_edits(facts)
    out = repair.apply_edits(rows, audit)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)) and cost <= 4
    assert repair.apply_edits([("system", "s."), ("user", "u.")], "KKI") == [("system", "s."), ("user", "u."), ("assistant", "")]


CONV = "conv_id bigint, turn bigint, role string, text string"


def report(spark, rows, schema=CONV):
    frame = spark.createDataFrame(rows, schema)
    for name in ("at", "gone", "fault", "n"):
        frame = frame.selectExpr("*", f"conv_id as {name}")
    return {r.conv_id: r for r in repair.digest(repair.repair(repair.plain(frame))).collect()}


def test_odd_conversations(spark):
    long = "word " * 60_000 + "end."
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."),
        (2, None, None, None), (2, 5, "user", "q."), (2, 9, "", "r."),
        (3, 0, "user", long), (3, 1, "assistant", long),
        (None, 0, "user", "a"), (None, 7, "assistant", "b."),
        (4, None, "user", " \t\r\n\x0b\x0c"),
    ]
    got = report(spark, rows)
    facts = {k: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for k, r in got.items()}
    assert facts[1] == (0, 0, 1, 0, 1, 2, "KKD")
    assert facts[2] == (3, 1, 0, 0, 2, 3, "DKR")
    assert facts[3] == (0, 0, 0, 0, 0, 0, "KK")
    assert facts[None] == (6, 0, 0, 1, 0, 4, "DD")
    assert facts[4] == (0, 1, 0, 0, 0, 2, "D")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got[1].repaired_sha256 == sha("user:Hi.\nassistant:Yes.")
    assert got[2].repaired_sha256 == sha("user:q.\nassistant:r.")
    assert got[None].repaired_sha256 == got[4].repaired_sha256 == sha("")
    assert report(spark, []) == {}


def test_damage(spark):
    rows = [(c, t, "assistant", "Who? Me! Yes.") for c in range(60) for t in range(4)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, CONV)
    got = Counter((r.conv_id, r.turn, r.role, r.text, r.gone) for r in repair.damage(frame).collect())
    want: Counter = Counter()
    for c, t, role, text in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        want[c, t, "user" if how == 4 else role, text, how == 0] += 2 if how == 3 else 1
    assert got == want


# --- URL filter ----------------------------------------------------------------------


def plain_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if ("." + host).endswith("." + r.host) and host and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


ODD_URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.Example.NET/en/x?a=1&b=2#f", "x://a.net?/q", "http://xnet/",
    "http://a.example.com/de/", "http://aexample.com/de/", "http://b.ORG/fr/1", "http://ÀÉ.org/fr/", "a://b://c.net/", "http://u@h.net:80/",
    "http://é.example.net/EN/", "http://n.net/" + "a/" * 60_000, "http://h.com/?q=" + "z" * 100_000, "http://net/\nline", "http://h.com/\n/de/",
]


def test_odd_urls(spark):
    rows = list(enumerate(ODD_URLS)) + [(None, "http://c.org/fr/a"), (5, "http://net/")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string")
    for name in ("html", "host", "order", "fold", "top", "score", "f_length"):
        frame = frame.selectExpr("*", f"page_id as {name}")
    got = Counter((r.page_id, r.host, r.path, r.rule) for r in urls.judge(frame).collect())
    assert got == Counter((i, *plain_rule(u)[:3]) for i, u in rows)
    assert urls.judge(frame.limit(0)).count() == 0
    # one verdict only, and none at all
    one = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/")], "page_id bigint, url string")
    assert {r.verdict for r in urls.judge(one).collect()} == {"block"}
    assert {r.verdict for r in urls.judge(one.filter("page_id = 2")).collect()} == {"allow"}


def test_rules_equal_plain_ones(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    got = QUERIES["op12_url_filter"](spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        host, path, rule, verdict = plain_rule(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_trees_judge_urls_held_out(spark):
    """URLs on which no rule decides get what urls of their kind are labelled as."""
    rules = (urls.Rule("block", "bad.test", "/"), urls.Rule("allow", "good.test", "/"))
    rng = np.random.default_rng(12)
    rows, truth = [], {}
    for i in range(1_500):
        bad = i % 3 == 0
        site = ("bad" if bad else "good") + ".test" if i % 2 else "other.test"
        word = "".join(rng.choice(list("0123456789" if bad else "aeioustr"), 12))
        tail = "?" + "&".join(f"p{k}={rng.integers(99999)}" for k in range(6)) if bad else ""
        rows.append((i, f"http://{word}.{site}/{'x/' * (4 if bad else 1)}{word}{tail}"))
        truth[i] = "block" if bad else "allow"
    frame = spark.createDataFrame(rows, "page_id bigint, url string")
    got = {r.page_id: r for r in urls.judge(frame, rules).collect()}
    held = [i for i in truth if i % 2 == 0]
    assert all(got[i].rule is None for i in held)
    assert np.mean([got[i].verdict == truth[i] for i in held]) > 0.97
    assert {i: r.score for i, r in got.items()} == {r.page_id: r.score for r in urls.judge(frame.repartition(5), rules).collect()}


def test_suffix_statistics_leave_a_row_out_of_its_own(spark):
    rows = [(i, f"http://h{i}.site{i % 2}.test/a") for i in range(40)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string")
    rules = (urls.Rule("block", "site0.test", "/"), urls.Rule("allow", "site1.test", "/"))
    parts = urls.with_rules(urls.with_parts(frame), rules).selectExpr("*", "pmod(page_id div 2, 5) as fold")
    got = urls._with_suffixes(urls._lexical(parts)).select("page_id", "f_site_seen", "f_site_share").collect()
    for r in got:
        left = 16  # 20 of the site, 4 of them in the row's fold
        assert r.f_site_seen == pytest.approx(np.log1p(left))
        assert r.f_site_share == pytest.approx(((0 if r.page_id % 2 else left) + 5 * 0.5) / (left + 5))


# --- spelling variants ---------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    count: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def as_docs(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in ("word", "run", "n", "m", "side", "cell", "id"):
        frame = frame.selectExpr("*", f"doc_id as {name}")
    return frame


@pytest.mark.parametrize("tile", [512, 6])
def test_variants_equal_brute_force(spark, monkeypatch, tile):
    """A small tile deals groups into blocks; words of few letters crowd the cells."""
    monkeypatch.setattr(spelling, "TILE", tile)
    rng = np.random.default_rng(13)
    rows = []
    for i in range(300):
        words = ["".join(rng.choice(list("abÀé"), rng.integers(5, 9))) for _ in range(40)]
        words += ["aaaaaa"] * 9 + ["Aaaaaab"] * int(rng.integers(3)) + ["aaaaabb"] * (i % 40 == 0)
        rows.append((None if i % 50 == 0 else i, " ".join(words)))
    got = spelling.variants(as_docs(spark, rows)).collect()
    want = plain_variants(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r.form for r in got)


def test_chain_of_forms(spark):
    rows = [(1, " ".join(["qwerty"] * 700 + ["qwertyu"] * 130 + ["qwertyui"] * 25 + ["qwertyuio"] * 5))]
    assert {tuple(r) for r in spelling.variants(as_docs(spark, rows)).collect()} == plain_variants(rows)
    assert {r[2] for r in plain_variants(rows)} == {"qwerty"}


def test_odd_documents(spark):
    giant, other = "g" * 70_000, "g" * 69_999
    rows = [(1, None), (2, ""), (None, "nothing here"), (3, "\U0001f600 " + " ".join([giant] * 6)), (4, " ".join([other] * 30))]
    rows += [(i, "×÷×÷×÷ ÀÉÎÕÜß àéîõüß x́yzabc") for i in range(5, 12)] + [(5, "×÷×÷×÷ ÀÉÎÕÜß")] * 2
    got = spelling.variants(as_docs(spark, rows)).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain_variants(rows)
    assert spelling.variants(as_docs(spark, [])).count() == 0


def test_every_pair_belongs_to_one_side():
    words = ["".join(w) for w in itertools.product("ab", repeat=6)] + ["".join(w) for w in itertools.product("ab", repeat=7)]
    seen: Counter = Counter()
    for m in (6, 7, 8):
        of = [w for w in words if len(w) in (m, m - 1)]
        for side in (0, 1):
            for i, j in zip(*np.nonzero(spelling.near_matrix(of, of, m, side))):
                seen[of[i], of[j]] += 1
    assert seen == Counter((a, b) for a in words for b in words if one_edit(a, b))
