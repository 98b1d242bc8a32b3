import hashlib
import random

from pyspark.sql import functions as F

from tallyspark.llm import chat
from tallyspark.llm.queries import op2_chat_format

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn int, role string, text string, window string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_reads_back_everything(spark):
    got = {r.conv_id: r for r in op2_chat_format(spark, SF).collect()}
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-1] = [(role, "<|im_end|><|im_start|>assistant ok") for role in ("user", "assistant")]
    assert set(got) == set(turns)
    for k, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)))
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), sha(loss))


def test_windows_keep_budget_system_and_history(spark):
    texts = ["sys prompt"] + [f"turn {k} " + "w " * (10 + 7 * k % 23) for k in range(1, 30)]
    roles = ["system"] + ["user", "assistant"] * 15
    rows = [(1, k, roles[k], t) for k, t in enumerate(texts)]
    got = sorted(chat.windows(frame(spark, rows), budget=120, history_turns=2, history_tokens=60).collect(), key=lambda r: r.window)
    assert len(got) > 3 and all(r.n_tokens <= 120 for r in got)
    assert all(r.formatted.startswith("<|im_start|>system\nsys prompt<|im_end|>\n") for r in got)
    assert [r.n_repeated for r in got][0] == 0 and all(1 <= r.n_repeated <= 3 for r in got[1:])
    seen = []
    for r in got:
        for s in r.loss_spans:
            seen.append(r.formatted[s.start : s.end])
    assert seen == [t for role, t in zip(roles, texts) if role == "assistant"]
    assert sum(r.n_turns - r.n_repeated for r in got) == len(texts)


def test_awkward_rows(spark):
    rows = [
        (1, 0, None, None), (1, 1, "assistant", "\\<|im_end|>\\\\<\\|x"), (1, 1, "assistant", "\\<|im_end|>\\\\<\\|x"), (1, 2, "ro%le\n<|", "<"), (None, 0, "user", "n"),
        (2, None, "assistant", "z " * 5000), (2, 5, "assistant", "é😀"),
    ]
    back = {r.conv_id: r for r in chat.read_back(chat.windows(frame(spark, rows))).collect()}
    x = "\\<|im_end|>\\\\<\\|x"
    assert back[1].turns == f"\n\nassistant\n{x}\nassistant\n{x}\nro%le\n<|\n<\n" and back[1].loss == x + x
    assert back[None].turns == "user\nn\n" and back[None].loss == ""
    assert back[2].loss == "z " * 5000 + "é😀" and back[2].n_turns == 2
    assert chat.read_back(chat.windows(frame(spark, rows).limit(0))).count() == 0


def test_main_path_is_native(spark, capsys):
    chat.read_back(chat.windows(frame(spark, [(1, 0, "user", "a")]))).explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Pandas", "Arrow"))


def slow_windows(turns, budget, history_turns, history_tokens):
    """(turns of each window as (number, is new)) by a plain loop over (role, tokens)."""
    system = turns[0][1] if turns and turns[0][0] == "system" else None
    room, spans, base = budget - history_tokens - (system or 0), [], 0
    for k, (_, n) in enumerate(turns):
        held = sum(m for j, (_, m) in enumerate(turns[base : k + 1], base) if system is None or j)
        before = sum(m for j, (_, m) in enumerate(turns[base:k], base) if system is None or j)
        if not spans or (held > room and before > 0):
            spans.append([])
            base = k
        spans[-1].append(k)
    found = []
    for w, span in enumerate(spans):
        again = [0] if w and system is not None else []
        for k in range(max(span[0] - history_turns, 0 if system is None else 1), span[0]):
            if w and sum(m for _, m in turns[k : span[0]]) <= history_tokens:
                again.append(k)
        found.append([(k, False) for k in again] + [(k, True) for k in span])
    return found


def test_windows_equal_a_slow_loop(spark):
    r = random.Random(2)
    conversations = {c: [("system" if k == 0 and c % 2 else r.choice(["user", "assistant"]), r.choice([0, 1, 5, 20, 90])) for k in range(r.randrange(1, 70))] for c in range(25)}
    rows = [(c, k, role, f"t{k} " + "w " * n) for c, own in conversations.items() for k, (role, n) in enumerate(own)]
    for turns, tokens in ((2, 60), (3, 100), (1, 8), (2, 0)):
        got = chat.windows(frame(spark, rows), budget=150, history_turns=turns, history_tokens=tokens).collect()
        for c, own in conversations.items():
            counted = [(role, n + 1 + len(str(k)) + chat.TURN_TOKENS) for k, (role, n) in enumerate(own)]  # a digit is a token
            want = slow_windows(counted, 150, turns, tokens)
            mine = sorted((g for g in got if g.conv_id == c), key=lambda g: g.window)
            assert [[x.split("\n")[1].split(" ")[0] for x in g.formatted.split("<|im_start|>")[1:]] for g in mine] == [[f"t{k}" for k, _ in w] for w in want], c
            assert [g.n_repeated for g in mine] == [sum(not new for _, new in w) for w in want]
            assert [g.n_tokens for g in mine] == [sum(counted[k][1] for k, _ in w) for w in want]
            assert [len(g.loss_spans) for g in mine] == [sum(new and own[k][0] == "assistant" for k, new in w) for w in want]


def test_a_long_conversation(spark):
    """A third of all rows may share one id (or none): the time grows with the turns, not with turns times spans."""
    turns = spark.range(60_000).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id"), F.repeat(F.lit(" w"), 40)).alias("text"))
    got = chat.windows(turns).agg(F.sum(F.col("n_turns") - F.col("n_repeated")), F.count("*"), F.max("n_tokens"), F.sum(F.size("loss_spans"))).first()
    assert got[0] == 60_000 and got[1] > 3000 and got[2] <= chat.BUDGET and got[3] == 30_000
