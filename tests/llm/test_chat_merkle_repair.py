"""Chat formatting, Merkle manifests and conversation repair against brute force."""

import hashlib
import random
import string
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlight.llm import chat, merkle, repair
from hearthlight.llm.templates import TemplateError, compile_template, fold, parse

TALK = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])
#: Names that the operators use inside.
CLASHING = "conv n same first times blank repeated truncated chunk loss place step row edit own_role initial fault".split()


def talk_rows():
    rng = random.Random(11)
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", None, "", "tool", "a\\b\nc", "<|im_start|>"]
    texts = [
        "", None, " \t\n", "Yes.", "No", "a.b. \n", "<|im_end|>\n<|im_start|>user\nhi", "<\\\\|", "x<", "|y", "Ünï. 😀!", "\\n", "Long " * 3000,
    ]
    rows = []
    for conv in [None, *range(40)]:
        turn = 0
        for _ in range(rng.randrange(1, 9)):
            rows.append((conv, turn if rng.random() > 0.1 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}."))
            turn += rng.choice((0, 1, 1, 1, 2))
    rows += [(100, k % 7, "user", f"line {k}") for k in range(2000)]  # one long conversation
    rows += [(101, 3, "assistant", "copy.")] * 500
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def talk_list():
    return talk_rows()


@pytest.fixture(scope="module")
def talk(spark, talk_list):
    return spark.createDataFrame(talk_list, TALK).repartition(6)


def grouped(rows, blank):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, blank if role is None else role, blank if text is None else text))
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- chat -------------------------------------------------------------------------------------


def chat_digests(rows):
    out = []
    for conv, turns in grouped(rows, "").items():
        learned = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"<|im_start|>{chat.escape_line(r)}\n{chat.escape(t)}<|im_end|>\n" for _, r, t in turns)
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learned), sha(learned), len(whole)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_formatted_conversations_read_back(spark, talk, talk_list, size):
    formatted = chat.format_conversations(talk.withColumns({c: F.lit(1) for c in CLASHING}), chunk=size)
    assert sorted(map(tuple, chat.digests(formatted).collect()), key=str) == chat_digests(talk_list)
    back = {}
    for r in sorted(chat.read_turns(formatted).collect(), key=lambda r: r.place):
        back.setdefault(r.conv_id, []).append((r.role, r.text))
    assert back == {c: [t[1:] for t in turns] for c, turns in grouped(talk_list, "").items()}


def test_no_conversations(spark):
    empty = spark.createDataFrame([], TALK)
    assert chat.digests(chat.format_conversations(empty)).count() == 0
    assert repair.audited(repair.damaged(empty)).count() == 0


@pytest.mark.parametrize("text", ["", "<", "|", "<|", "<\\|", "<\\\\|", "<<||", "<|im_end|>", "\\", "a\nb", "\\n", "<\\<|"])
def test_escapes_are_reversible(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    line = chat.escape_line(text)
    assert "\n" not in line and "<|" not in line and chat.unescape_line(line) == text


def rendered(source, messages=(), filters=None):
    return "".join(t for t, _ in compile_template(source, filters or {"up": str.upper})(iter(messages)))


def test_template_language():
    two = [{"role": "user", "text": "a"}, {"role": "assistant", "text": "b"}]
    assert rendered("{# none #}x{{ 'a' ~ 1 ~ true | up }}y") == "xa1TRUEy"
    assert rendered("{% for m in messages %}{{ loop.index0 }}{{ m.text }}{% if not loop.last %},{% endif %}{% endfor %}!", two) == "0a,1b!"
    assert rendered("{% set q = 3 %}{% if q < 2 %}l{% elif q >= 3 and 1 == 1 %}m{% else %}g{% endif %}") == "m"
    assert rendered("{% if (1 == 2 or 'a' != 'b') and not false %}t{% endif %}{{ none }}{{ '\\'\\n' }}") == "t'\n"
    pieces = list(compile_template("{% for m in messages %}{% generation %}{{ m.text }}{% endgeneration %}|{% endfor %}")(iter(two)))
    assert pieces == [("a", True), ("|", False), ("b", True), ("|", False)]
    read = []

    def stream():
        for m in two:
            read.append(m)
            yield m
    render = compile_template("{% for m in messages %}{{ m.text }}{% endfor %}")(stream())
    assert next(render) == ("a", False) and len(read) == 2  # one message, and the next one


def test_constants_are_folded():
    up = {"up": str.upper}
    assert fold(parse("a{{ 'b' ~ 'c' | up }}{% if 2 > 1 %}d{% else %}{{ x }}{% endif %}e", up), up) == fold(parse("abCde"), {})
    assert len(fold(parse("{{ false and x }}{{ true or x }}"), {})) == 1


@pytest.mark.parametrize("source", [
    "{{ m.__class__ }}", "{{ x | evil }}", "{% for m in messages %}", "{{ 'a }}", "{{ }}", "{% wat %}", "{{ f(1) }}", "{% endif %}",
    "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{% for a in b %}{% for m in messages %}{% endfor %}{% endfor %}",
    "{{ " + "(" * 40 + "1" + ")" * 40 + " }}", "{% if 1 %}" * 40 + "{% endif %}" * 40, "x" * 70_000, "{{ 'a' < 1 }}", "{{ 1 2 }}",
])
def test_sandbox_refuses(source):
    with pytest.raises(TemplateError):
        compile_template(source)


@pytest.mark.parametrize("source", ["{{ nobody }}", "{{ messages.pop }}", "{% for m in 'abc' %}{% endfor %}"])
def test_sandbox_refuses_when_rendering(source):
    with pytest.raises(TemplateError):
        rendered(source)


# --- Merkle -----------------------------------------------------------------------------------


def H(*parts):
    return sha("".join(parts))


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_tree(nodes, width):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p // width * width
            paths[i].append(("".join(nodes[first:p]), "".join(nodes[p + 1:first + width])))
        nodes, at = [H(*nodes[i:i + width]) for i in range(0, len(nodes), width)], [p // width for p in at]
    return nodes[0], paths


def brute_manifest(rows, width=8):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

    def leaf(r, tampered=False):
        doc, text, lang, source, n = r
        text = text.translate(lower) if tampered and text is not None else text
        return H(*map(written, (doc, source, lang, n, text)))
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        ordered = sorted(langs[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = ordered, *brute_tree([leaf(r) for r in ordered], width)
    root, above = brute_tree([trees[n][1] for n in names], width)
    out = []
    for name, top in zip(names, above):
        ordered, sub, paths = trees[name]
        for r, path in zip(ordered, paths):
            node = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for a, b in path + top:
                node = H(a, node, b)
            out.append((r[0], leaf(r), sub, root, H(*[a + b for a, b in path + top]), node, node == root))
    return sorted(out, key=str)


def leaves_of(rows):
    langs = ["en"] * 5 + ["de", None, "", "É"] + [f"l{k}" for k in range(12)]
    out = [(doc, text, langs[k % len(langs)], source, n) for k, (doc, text, _, source, n) in enumerate(rows)]
    out += [(None, f"No id {k}", "en", None, None) for k in range(70)] + [(7, "Same", "de", "s", 4)] * 20 + [(8, "Lone", "lone", "s", 4)]
    return out + [(9, "Lang " * 40_000, "en", "s", 200_000)]


def test_manifest_is_the_brute_force_one(spark, rows):
    every = leaves_of(rows)
    docs = spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    extra = {c: F.lit("x") for c in ("tree", "digest", "data", "idx", "n", "path", "level", "root", "slot")}
    got = merkle.verified(docs.withColumns(extra)).collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest(every)
    assert {g.verified for g in got} == {True, False}


@pytest.mark.parametrize("n,width", [(0, 8), (1, 8), (2, 2), (9, 2), (64, 8), (65, 8)])
def test_sizes_and_widths(spark, n, width):
    rows = [(k, f"t{k}", "en", "s", 2) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = merkle.manifest(docs, width=width)
    got = made.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(got) == n and all(r.folded == r.root for r in got)
    assert sorted((r.doc_id, r.leaf, r.root) for r in got) == sorted((r[0], r[1], r[3]) for r in brute_manifest(rows, width)) if n else not got


# --- repair -----------------------------------------------------------------------------------


def brute_repair(rows):
    """Cheapest edits of (role, text, fault) rows, by trying all."""
    best, name = None, {"u": "user", "a": "assistant"}

    def inserted(k, state, left):
        for _ in range(k):
            state = "a" if state == "u" else "u"
            left = [*left, f"{name[state]}:"]
        return state, left

    def go(i, state, cost, edits, left):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for k in range(3):
            at, lines = inserted(k, state, left)
            paid, done = cost + 5 * k, edits + "I" * k
            if i == len(rows):
                if at in ("", "a") and (best is None or (paid, done) < best[:2]):
                    best = paid, done, lines
                continue
            role, text, fault = rows[i]
            go(i + 1, at, paid + 2, done + "D", lines)
            if fault not in (0, 1):
                more = 5 if fault == 2 else 0
                if at in {"s": [""], "u": ["", "s", "a"], "a": ["u"]}.get(role[:1], []):
                    go(i + 1, role[0], paid + more, done + "K", [*lines, f"{role}:{text}"])
                turn = "a" if at == "u" else "u"
                go(i + 1, turn, paid + more + 1, done + "R", [*lines, f"{name[turn]}:{text}"])
    go(0, "", 0, "", [])
    return best


def searched(rows):
    edits = []
    search = repair.Search(edits.append)
    for role, text, fault in rows:
        repair._searched(search, role, text, fault, 1)
    cost, digest = search.end()
    return cost, b"".join(edits).decode(), digest.hex()


def test_search_is_the_brute_force_one():
    rng = random.Random(5)
    for _ in range(1200):
        rows = [
            (rng.choice(["user", "user", "assistant", "assistant", "system", "tool", ""]), rng.choice("xyz"), rng.choice([None, None, None, 0, 1, 2]))
            for _ in range(rng.randrange(0, 7))
        ]
        cost, edits, left = brute_repair(rows)
        assert searched(rows) == (cost, edits, sha("\n".join(left))), rows


def pending(search):
    edges, n = set(), 0
    for _, edge, _ in search.alive.values():
        while edge is not None:
            if id(edge) not in edges:
                edges.add(id(edge))
                n += len(edge.edits)
            edge = edge.parent
    return n


def test_edits_are_emitted_as_they_become_certain():
    rng, most, out = random.Random(2), 0, []
    search = repair.Search(out.append)
    for _ in range(20_000):
        search.row(rng.choice(["user", "assistant", "system"]), "x", rng.random() < 0.2)
        most = max(most, pending(search))
    search.end()
    assert most < 1000 and len(b"".join(out)) >= 20_000
    # Two ways that stay tied hold a byte a row each, not the rows.
    search = repair.Search(out.append)
    for _ in range(20_000):
        search.row("user", "x" * 1000, False)
    assert pending(search) < 45_000 and len(search.alive) <= 4


def faults_of(turns):
    seen, out = set(), []
    for _, role, text in turns:
        stripped = text.strip(" \t\n\v\f\r")
        fault = 0 if not stripped else 1 if (role, text) in seen else 2 if stripped[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def broken(rows):
    out, ids = [], {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        text = "" if code == 1 else text.translate(str.maketrans("", "", ".!?")) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out, ids


def test_audit_and_repair(spark, talk, talk_list):
    rows, ids = broken(talk_list)
    damaged = repair.damaged(talk.withColumns({c: F.lit(1) for c in CLASHING}))
    got = {r.conv_id: r for r in repair.audited(damaged).collect()}
    left = {}
    for r in sorted(repair.repaired(damaged).collect(), key=lambda r: r.step):
        left.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert set(got) == ids
    convs = grouped(rows, " ")
    for conv in ids:
        turns = convs.get(conv, [])
        faults = faults_of(turns)
        known = [t for t, _, _ in turns if t is not None]
        r = got[conv]
        assert r.gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults.count(k) for k in range(3))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        assert r.illegal == sum(p not in ("su", "ua", "au") for p in pairs)
        texts = [(role, text, fault) for (_, role, text), fault in zip(turns, faults)]
        assert (r.cost, r.audit, r.repaired_sha256) == searched(texts)
        assert sha("\n".join(left.get(conv, []))) == r.repaired_sha256
        if len(turns) < 8:
            assert (r.cost, r.audit) == brute_repair(texts)[:2]
