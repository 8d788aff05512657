"""Reply trees against a plain walk, and the template's round trip."""

import hashlib
import random

from vqspark.llm import chat

ODD = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\/s>", "<<SYS>>x<</SYS>>", "[[INST]", "<</s>", "<", "[", "a\nb", "", None, "𝔘 é", "$1 \\1", "x" * 100_000]


def plain_paths(messages, per_tree):
    trees = {}
    for t, n, p, s in messages:
        trees.setdefault(t, {})[n] = (p, s or 0.0)
    out = set()
    for t, nodes in trees.items():
        parents = {p for p, _ in nodes.values() if p in nodes}
        found = []
        for leaf in set(nodes) - parents:
            path = [leaf]
            while nodes[path[-1]][0] in nodes:
                path.append(nodes[path[-1]][0])
            found.append((-sum(nodes[n][1] for n in path), -len(path), leaf, path))
        for rank, (*_, leaf, path) in enumerate(sorted(found)[:per_tree], 1):
            out |= {(t, leaf, rank, len(path) - 1 - i, n) for i, n in enumerate(path)}
    return out


def test_paths_against_walk(spark):
    rng = random.Random(5)
    messages = []
    for t in [*range(12), None]:
        for n in range(rng.randint(1, 40)):
            messages.append((t, n, rng.choice([None, *range(n), n - 1, 999] if n else [None, 77]), rng.choice([None, 0.0, 0.5, 1.0, -2.0])))
    messages += [(50, n, n - 1 if n else None, 1.0) for n in range(200)]
    messages += [(60, 0, 1, 1.0), (60, 1, 0, 1.0)]
    frame = spark.createDataFrame(messages, "tree_id long, node_id long, parent_id long, score double")
    for per_tree in (1, 3):
        found = [tuple(r) for r in chat.paths(frame, per_tree).select("tree_id", "path", "rank", "depth", "node_id").collect()]
        assert len(found) == len(set(found))
        assert set(found) == plain_paths([m for m in messages if m[0] != 60], per_tree)


def test_round_trip(spark):
    rows = [(1, i, ["user", "assistant", "system", None, "</s>", "assistant"][i % 6], t, "f", 3) for i, t in enumerate(ODD)]
    rows += [(2, 0, "assistant", "x", "f", 3), (2, 0, "assistant", "x", "f", 3), (2, None, "user", "last", "f", 3), (None, 0, "user", "n", "f", 3), (3, 0, "user", "only", "f", 3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, depth int")
    out = chat.format_conversations(frame)
    found = {r.conv_id: r for r in chat.digests(out).collect()}
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert set(found) == {1, 2, 3, None}
    for c in found:
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is None, r[1], r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        assert [tuple(x) for x in back[c].turns] == turns
        loss = "".join(t for r, t in turns if r == "assistant")
        assert found[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and found[c].loss_chars == len(loss)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert found[c].n_turns == len(turns) and found[c].formatted_chars == len(back[c].formatted)
        assert back[c].formatted.count(chat.END) == back[c].formatted.count(chat.OPEN) == len(turns)


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(frame).count() == 0
