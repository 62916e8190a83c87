"""Made-up texts and the table names that tests share."""

import random

SF = "/root/testdata/sf0.001"

#: Extra columns with names that the operators use inside.
EXTRA = "id int, key string, size int, bucket int, n_words string, items int, hits int, path string, run int, shard int, n int, length int, slot int, score string"


def prose(seed, n):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["an", "te", "ro", "li", "mu", "so"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    return " ".join(rnd.choice(words) + rnd.choice(["", "", "", ".", ","]) for _ in range(n))
