"""A seeded generator of annotated sentences with valid check digits."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

from lakewarden.sources.readers import EVAL_SCHEMA

_TEMPLATES = (
    "Bitte schreiben Sie an {EMAIL} wegen Rechnung 4711.",
    "Die Zahlung geht auf {IBAN} und nicht auf das alte Konto.",
    "{PERSON} erreichen Sie unter {EMAIL}.",
    "Der Dienst nutzt {SECRET} noch bis Freitag.",
    "Am Montag ist das Büro geschlossen.",
)
_UMLAUTS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})


def iban(rng: random.Random, country: str = "DE", digits: int = 18) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(digits))
    rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{98 - rest:02d}{body}"


def sentences(spark: SparkSession, n: int, seed: int = 7, given=("Jana", "Özil"), surnames=("Schäfer", "Weiß")) -> DataFrame:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = f"{rng.choice(given)} {rng.choice(surnames)}"
        mail = name.lower().replace(" ", ".").translate(_UMLAUTS).replace("ö", "oe") + "@example.org"
        values = {"EMAIL": mail, "IBAN": iban(rng), "PERSON": name, "SECRET": "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQR234567") for _ in range(16))}
        text, entities, rest = "", [], _TEMPLATES[i % len(_TEMPLATES)]
        while "{" in rest:
            head, _, tail = rest.partition("{")
            kind, _, rest = tail.partition("}")
            text += head
            entities.append((len(text), len(text) + len(values[kind]), kind, values[kind], False))
            text += values[kind]
        rows.append((f"s{i}", text + rest, entities, ["synthetic"]))
    return spark.createDataFrame(rows, EVAL_SCHEMA)
