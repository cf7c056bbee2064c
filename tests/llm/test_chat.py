import hashlib

import pytest

from mentionlab.llm import chat

HARD = ["", "\\", "\\\\h", "###", "#####\\", "</turn>\n", "</tu</turn>rn>\\e", "\\### Assistant: </turn> ok", "é𝒳\n### user: a</turn>\n", "a: b", None]


def test_round_trip(spark):
    rows = [(i, k, r, t) for i, r in enumerate(["user", "assistant", "a:b\\###", None]) for k, t in enumerate(HARD)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_trees(chat.chains(conv.selectExpr("*", "1 AS tree", "2 AS node")))
    back = sorted((r.tree, r.k, r.role, r.text, r.in_loss) for r in chat.read_back(chats, "tree", "leaf").collect())
    assert back == sorted((f"id {i}", k, r or "", t or "", r == "assistant") for i, k, r, t in rows)
    for c in chats.collect():
        assert c.formatted.count("### ") == c.formatted.count("</turn>") == len(HARD)


def brute(messages, best):
    by = {}
    for tree, node, parent, role, text, score in messages:
        by.setdefault(tree, {})[node] = (parent, role, text, score)
    out = {}
    for tree, nodes in by.items():
        parents = {v[0] for v in nodes.values()}
        branches = []
        for leaf in nodes:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in nodes:
                path.append(at)
                at = nodes[at][0]
            path.reverse()
            mean = sum(nodes[n][3] for n in path) / len(path)
            branches.append((-mean, leaf, path))
        for rank, (_, leaf, path) in enumerate(sorted(branches)[:best], 1):
            out[tree, leaf] = (rank, "".join(f"### {nodes[n][1]}: {nodes[n][2]}</turn>\n" for n in path))
    return out


@pytest.mark.parametrize("best", [None, 1, 2])
def test_trees(spark, best):
    messages = []
    for t in range(5):
        for n in range(60):
            parent = None if n == 0 else 999 if n == 7 else (n * 7 + t) % n if n % 3 else n - 1
            messages.append((f"t{t}", n, parent, "assistant" if n % 2 else "user", f"text {n}", float((n * 13 + t) % 5)))
    df = spark.createDataFrame(messages, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): (r["rank"], r.formatted) for r in chat.format_trees(df, best).collect()}
    assert got == brute(messages, best)


def test_cycle_is_refused(spark):
    df = spark.createDataFrame([("t", 1, 2), ("t", 2, 1), ("t", 3, 1)], "tree string, node long, parent long").selectExpr("*", "'u' role", "'x' text", "0D score")
    with pytest.raises(ValueError):
        chat.format_trees(df)


def test_odd_tables(spark):
    rows = [(None, 1, "user", "x"), (None, None, "assistant", "y"), (1, 1, "user", "same"), (1, 1, "user", "same"), (2, 1, "assistant", "w " * 100000)] + [(3, i, "assistant", f"é{i}") for i in range(3000)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in chat.format_trees(chat.chains(conv)).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {"none": 2, "id 1": 2, "id 2": 1, "id 3": 3000}
    assert got["none"].formatted == "### assistant: y</turn>\n### user: x</turn>\n"
    f = got["id 3"].formatted
    assert "".join(f[s.start : s.end] for s in got["id 3"].loss) == "".join(f"é{i}" for i in range(3000))
    assert chat.format_trees(chat.chains(conv.limit(0))).count() == 0


def test_query(spark, sf_dir):
    got = {r.conv_id: r for r in chat.op3_chat(spark, sf_dir).collect()}
    rows = sorted((r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect())
    rows = [(chat.TRIAL[0], 0, "user", chat.TRIAL[1]), (chat.TRIAL[0], 1, "assistant", chat.TRIAL[1])] + rows
    for c in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == c]
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in mine).encode()).hexdigest()
        loss = "".join(r[3] for r in mine if r[2] == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].n_turns) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(mine))
