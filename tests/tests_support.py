"""Op logs for tests, and their sequential fold."""

import random

from keystrata.streaming.replayer import fold

SCHEMA = "session_id long, seq long, key string, op string, doc string"


def ops_of(spark, rows):
    return spark.createDataFrame([(0, s, k, o, d) for k, s, o, d in rows], SCHEMA)


def folded(rows):
    """Replies by a sequential fold, and the live documents."""
    state, out = {}, {}
    for key, seq, op, doc in sorted(rows, key=lambda r: r[1]):
        now, reply, applied = fold(key, state.get(key, (None, 0, 0, None)), op, seq, doc)
        state[key] = now
        out[(key, seq)] = (reply, applied, now[1], now[2] if now[3] is not None else None)
    return out, {k: (s[2], s[3]) for k, s in state.items() if s[3] is not None}


def random_log(seed, n, n_keys=5):
    r = random.Random(seed)
    return [(format(r.randrange(n_keys), "X"), i, r.choice(["save_key", "update", "delete", "lookup"]), r.choice([None, "", "x", "y" * 3])) for i in range(n)]
