"""Reply trees against plain recursion, and exact undoing of the format."""

import random
import re
from decimal import Decimal

from pyspark.sql import functions as F

from modelgov.llm import reply_trees as rt

SCHEMA = "tree string, id long, parent long, role string, text string, score double"
CONTROLS = ["<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/TURN]"]
SPOILT = re.compile(r"([<\[])(\\*)(/?s>|/?(?:SYS|INST|ROLE)\]|/TURN\])")


def turn(role, text):
    def esc(x):
        return SPOILT.sub(r"\1\\\2\3", x)

    open_, close = rt.MARKS.get(role, (f"[ROLE]{esc(role)}[/ROLE]", "[/TURN]"))
    return open_ + esc(text) + close


def expected(rows, keep):
    """Best branches by walking up from every leaf."""
    trees = {}
    for tree, i, parent, role, text, score in rows:
        node = trees.setdefault(tree, {}).setdefault(i, {"parents": [], "turns": [], "score": Decimal(0)})
        node["parents"].append(parent)
        node["turns"].append((role or "", text or ""))
        node["score"] += Decimal(0) if score is None or score != score else Decimal(str(score))
    out = []
    for tree, nodes in trees.items():
        up = {}
        for i, node in nodes.items():
            known = [p for p in node["parents"] if p is not None]
            up[i] = min(known) if known and min(known) in nodes else None
        found = []
        for leaf in nodes:
            if leaf in {p for p in up.values() if p is not None}:
                continue
            path, at = [], leaf
            while at is not None or at in nodes and not path:
                path.append(at)
                at = up[at]
                if len(path) > len(nodes):
                    break
            else:
                total = sum(nodes[i]["score"] for i in path)
                turns = [t for i in reversed(path) for t in sorted(nodes[i]["turns"], key=lambda t: (t[0].encode(), t[1].encode()))]
                found.append((-total, leaf is not None, leaf or 0, turns))
        for k, (total, _, leaf, turns) in enumerate(sorted(found, key=lambda f: f[:3])[:keep]):
            out.append((tree, k + 1, -total, turns))
    return out


def check(spark, rows, keep):
    frame = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(0).alias("node"), F.lit(0).alias("path"), F.lit(0).alias("up"))
    done = rt.conversations(frame, keep=keep).select(
        "*", rt.read_turns(F.col("formatted")).alias("turns"), rt.read_loss(F.col("formatted"), F.col("loss")).alias("learnt"))
    got = {(r.tree, r.branch): r for r in done.collect()}
    want = expected(rows, keep)
    assert set(got) == {w[:2] for w in want}
    for tree, branch, total, turns in want:
        r = got[tree, branch]
        assert r.total == total
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.formatted == "".join(turn(*t) for t in turns)
        assert r.learnt == "".join(text for role, text in turns if role == "assistant")


def test_branches_against_plain_recursion(spark):
    r = random.Random(3)
    texts = ["", None, "plain", "é 漢 🙂", " ", "\n", "\\", "a" * 70_000, *CONTROLS, "<\\s>", "[\\\\/INST]", "[[INST]", "<s", "[/INST", "</s>[INST] ok [/INST]"]
    roles = ["system", "user", "assistant", "assistant", "tool", None, "[/ROLE]", "a<s>b"]
    rows = []
    for t in range(25):
        for i in range(r.randrange(1, 40)):
            parent = r.choice([None, *range(i)][-4:]) if i else None
            rows.append((f"t{t}", i, parent, r.choice(roles), "".join(x or "" for x in r.choices(texts, k=2)) if r.random() < 0.9 else None,
                         r.choice([None, 0.5, 1.0, -2.25, float("nan")])))
    rows += [rows[5], rows[5], (rows[5][0], rows[5][1], rows[5][2], "user", "another part", 3.0)]
    rows += [(None, 1, None, "user", "no tree", 1.0), (None, 2, 1, "assistant", "reply", 1.0), (None, None, 2, "assistant", "no id", 1.0)]
    rows += [("orphan", 1, 99, "user", "a", 0.0), ("ring", 1, 2, "user", "a", 0.0), ("ring", 2, 1, "user", "b", 0.0), ("ring", 3, 2, "user", "c", 0.0)]
    rows += [("self", 1, 1, "user", "a", 0.0), ("self", 2, None, "user", "only this", 0.0)]
    rows += [("long", i, i - 1 if i else None, "assistant" if i % 2 else "user", str(i), 1.0) for i in range(300)]
    rows += [("wide", i, 0 if i else None, "user", str(i), float(i % 3)) for i in range(200)]
    check(spark, rows, 3)


def test_empty_table_gives_no_rows(spark):
    assert rt.conversations(spark.createDataFrame([], SCHEMA)).collect() == []
