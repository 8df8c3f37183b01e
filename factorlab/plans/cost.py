"""What an iteration costs by strategy, from the sizes of the data: the choice behind ``strategy="auto"``.

The constants were fitted to one sweep over ranks 2 to 40 of 52,000 and 597,000 merged ratings on
two cores, each fit's second iteration. They order strategies; they do not predict seconds elsewhere.
"""

from __future__ import annotations

import math

from factorlab.operators.normal_eq import MAX_COLUMN_RANK

# Seconds of an iteration whatever its data: jobs, checkpoints and, for the broadcast, fetching the factors.
FIXED = {"broadcast": 0.6, "blocked": 1.2, "join": 0.9, "gather": 0.9}
# Seconds of a core for a rating read in a half-step, and more for each rank.
READ = {"broadcast": (2.6e-6, 4.4e-8), "blocked": (3.0e-6, 4.4e-8), "join": (1.2e-6, 0.0), "gather": (2.5e-6, 2.8e-7)}
# Seconds of a core for a sum column of a rating, and for a number of a message.
COLUMN, NUMBER = 9.3e-8, 1e-8
# Bytes a second that pass the driver and reach every executor.
THROUGH_DRIVER = 5e7


def sent_vectors(keys: int, rows: int, blocks: int) -> float:
    """Vectors that the ids of a side send in a half-step: one for each block that any of their ratings falls into."""
    return keys * blocks * -math.expm1(-rows / max(keys, 1) / blocks)


def estimate(rows: int, u_keys: int, i_keys: int, rank: int, blocks: int, cores: int, broadcast_bytes: int) -> dict[str, float]:
    """Seconds of one iteration, two half-steps, for each strategy that may run as itself on both sides."""
    reads = 2 * rows / max(cores, 1)
    seconds = {name: FIXED[name] + reads * (base + rank * more) for name, (base, more) in READ.items()}
    if rank <= MAX_COLUMN_RANK:
        seconds["join"] += reads * COLUMN * rank * (rank + 3) / 2
    else:
        seconds["join"] = seconds["gather"]  # folds or lists: alike, as measured
    seconds["blocked"] += (sent_vectors(u_keys, rows, blocks) + sent_vectors(i_keys, rows, blocks)) * rank * NUMBER / max(cores, 1)
    seconds["broadcast"] += (u_keys + i_keys) * rank * 8 / THROUGH_DRIVER
    if max(u_keys, i_keys) * (8 * rank + 48) > broadcast_bytes:
        del seconds["broadcast"]
    return seconds
