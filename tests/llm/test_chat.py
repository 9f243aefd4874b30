import random

from pyspark.sql import functions as F

from triplane.llm.chat import format_reply_trees, reply_parents

SCHEMA = "tree long, node long, parent long, role string, text string, extra int, score string"


def brute(rows, best):
    trees = {}
    for tree, node, parent, role, text in rows:
        trees.setdefault(tree, {})[node] = (parent, role, text)
    out = []
    for tree, nodes in trees.items():
        parents = {p for p, _, _ in nodes.values()}
        paths = []
        for leaf in nodes:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in nodes and len(path) <= len(nodes):
                path.append(at)
                at = nodes[at][0]
            if len(path) > len(nodes):
                continue  # below a cycle
            path.reverse()
            scores = [len(nodes[x][2]) if nodes[x][1] == "assistant" else 0 for x in path]
            paths.append((-sum(scores) / len(path), leaf, path))
        for branch, (mean, leaf, path) in enumerate(sorted(paths)[:best], 1):
            out.append((tree, branch, leaf, len(path), -mean, "".join(f"<|{nodes[x][1]}|>\n{nodes[x][2]}\n" for x in path)))
    return sorted(out)


def test_same_as_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for tree in range(12):
        for node in range(1, rng.randint(2, 40)):
            parent = rng.choice([node - 1, rng.randint(1, node)]) if node > 1 else None
            rows.append((tree, node, parent if parent != node else None, rng.choice(["user", "assistant"]), "x" * rng.randint(0, 4)))
    rows += [(50, n, n - 1 or None, "assistant", str(n)) for n in range(1, 70)]  # deep
    rows += [(51, 1, 2, "user", "a"), (51, 2, 1, "user", "b"), (51, 3, 2, "user", "c"), (51, 4, None, "user", "d")]  # a cycle
    rows += [(52, 9, 8, "user", "parent is absent"), (52, 10, 9, "assistant", "x" * 50_000)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA)
    for best in (1, 3):
        assert sorted(map(tuple, format_reply_trees(df, best=best).collect())) == brute(rows, best)


def test_nulls_ties_repeats_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string, tree int, node string"
    rows = [(1, 1, "user", "q", 0, ""), (1, 1, "user", "q", 0, ""), (1, 2, "assistant", "aa", 0, ""), (1, 3, "assistant", "bb", 0, ""), (2, 1, None, None, 0, ""), (None, 1, "user", "x", 0, ""), (3, None, "user", "x", 0, "")]
    got = sorted(map(tuple, format_reply_trees(reply_parents(spark.createDataFrame(rows, schema)), best=1)
                     .select("tree", "leaf", "n_messages", "conversation").collect()))
    assert got == [(1, 2, 2, "<|user|>\nq\n<|assistant|>\naa\n"), (2, 1, 1, "<|unknown|>\n\n")]
    assert format_reply_trees(reply_parents(spark.createDataFrame([], schema))).collect() == []


def test_rows_that_repeat_or_lack_a_key(spark):
    rows = [(1, 1, None, "user", "q"), (1, 1, None, "user", "q"), (1, 2, 1, "assistant", "a"), (1, 2, 1, "assistant", "a"), (1, 2, 1, "assistant", "b"), (1, 3, 2, None, None), (None, 1, None, "user", "x"), (2, None, None, "user", "x"), (1, 4, 1, "user", "z")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA)
    got = sorted(map(tuple, format_reply_trees(df, best=5).select("branch", "leaf", "n_messages", "conversation").collect()))
    assert got == [(1, 3, 3, "<|user|>\nq\n<|assistant|>\na\n<|unknown|>\n\n"), (2, 4, 2, "<|user|>\nq\n<|user|>\nz\n")]
    assert len(format_reply_trees(df, score=F.lit(None)).collect()) == 2


def test_parents_of_a_conversation_cut_into_ranges(spark):
    rng = random.Random(6)
    rows = [(9, t, rng.choice(["user", "assistant"]), f"m{t}") for t in range(3000)] + [(c, t, rng.choice(["user", "assistant"]), "x") for c in range(20) for t in range(rng.randint(1, 9)) if c != 9]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wanted = {}
    for c, t, role, _ in sorted(rows):
        nodes = wanted.setdefault(c, [])
        run = nodes[-1][1] if nodes and nodes[-1][2] == role else len(nodes) + 1
        nodes.append((len(nodes) + 1, run, role))
    for partitions in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = sorted((r["tree"], r["node"], r["parent"], r["role"]) for r in reply_parents(df).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == sorted((c, n, run - 1 or None, role) for c, nodes in wanted.items() for n, run, role in nodes)
