import itertools
import random

from vouchlake.llm import chat


def _legal(roles):
    state = "S"
    for r in roles:
        if r not in chat.LEGAL[state]:
            return False
        state = r
    return state == "assistant"


def _cheapest(roles, limit=3):
    """Least cost over all repairs, by trying every assignment of roles, merges and empty messages."""
    best = 10**9
    for new in itertools.product(chat.ROLES, repeat=len(roles)):
        base = sum(0 if a == b else chat.RELABEL[(a, b)] for a, b in zip(roles, new, strict=True))
        for merges in itertools.product((False, True), repeat=len(roles)):
            if any(m and (i == 0 or new[i] != new[i - 1]) for i, m in enumerate(merges)):
                continue
            seq = [r for r, m in zip(new, merges, strict=True) if not m]
            cost, state = base + chat.MERGE * sum(merges), "S"
            for r in [*seq, "END"]:
                paths = [()] + [(a,) for a in chat.ROLES] + [(a, b) for a in chat.ROLES for b in chat.ROLES]
                fits = [p for p in paths if (_chain(state, p) is not None) and (_chain(state, p) == "assistant" if r == "END" else r in chat.LEGAL[_chain(state, p)])]
                if not fits:
                    cost = 10**9
                    break
                cost += chat.INSERT * len(min(fits, key=len))
                state = r
            best = min(best, cost)
    return best


def _chain(state, path):
    for r in path:
        if r not in chat.LEGAL[state]:
            return None
        state = r
    return state


def test_plan_costs_the_least():
    for n in range(1, 4):
        for roles in itertools.product((*chat.ROLES, None), repeat=n):
            assert chat.plan(list(roles))[1] == _cheapest(roles), roles


def _messages(rendered):
    out = []
    for part in rendered.split(chat.TEMPLATE[2])[:-1]:
        role, text = part[len(chat.TEMPLATE[0]) :].split(chat.TEMPLATE[1], 1)
        out.append((role, text))
    return out


def test_conversations_are_legal_and_cost_the_least_over_any_partitions(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(30):
        n = 400 if conv == 7 else rng.randrange(1, 9)
        rows += [(conv, t, rng.choice(["user", "assistant", "Human ", "system", "tool", None]), f"m{conv}.{t}") for t in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seen = []
    for parts in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = chat.repair_conversations(df).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        by = {}
        for r in sorted(got, key=lambda r: r.turn):
            by.setdefault(r.conv_id, []).append(r)
        assert sum(map(len, by.values())) == len(rows)
        costs = {}
        for conv, rs in by.items():
            messages = _messages("".join(r.rendered for r in rs))
            assert _legal([m[0] for m in messages])
            assert [x for m in messages for x in m[1].split("\n\n") if x] == [f"m{conv}.{r.turn}" for r in rs]
            known = [chat.ALIASES.get((r.role or "").strip().lower()) for r in rs]
            costs[conv] = sum(r.cost for r in rs)
            assert costs[conv] == chat.plan(known)[1]
        seen.append(costs)
    assert seen[0] == seen[1]


def test_nulls_ties_and_other_columns(spark):
    rows = [(None, 1, "user", "q", 1), (1, None, "user", "first", 2), (1, 1, "user", None, 3), (1, 1, "user", None, 3), (2, 5, "assistant", "x" * 100_000, 4)]
    got = chat.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")).collect()
    assert len(got) == 5
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.turn is not None, r.rendered))
    assert one[0].starts_message and one[0].turn is None
    alone = next(r for r in got if r.conv_id is None)
    assert _messages(alone.rendered) == [("user", "q"), ("assistant", "")] and alone.cost == chat.INSERT
    late = next(r for r in got if r.conv_id == 2)
    assert late.inserted == "user" and _messages(late.rendered)[0] == ("user", "")
    assert chat.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
