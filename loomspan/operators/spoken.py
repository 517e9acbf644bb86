"""NLP-02: what a recogniser's words become: compounds of several words, numbers in letters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ["", "thousand", "million", "billion"]


def compounds(words: Column, table: dict[str, str]) -> Column:
    """``words`` with every run of two and more that is a key of ``table`` (words joined by blanks, in lower case) replaced by its value:
    from the left, the longest that fits, none inside another.

    The table goes to the tasks with the code, so it has to be small: some hundred entries, checked here.
    """
    if len(table) > 2000 or any(k != " ".join(k.lower().split()) or " " not in k for k in table):
        raise ValueError("compounds are up to 2000 keys of several words in lower case, joined by single blanks")
    if not table:
        return words
    lengths = sorted({k.count(" ") + 1 for k in table}, reverse=True)

    def replaced(w, low) -> list:
        out, i = [], 0
        while i < len(w):
            for n in lengths:
                run = low[i : i + n]
                if len(run) == n and None not in run and (new := table.get(" ".join(run))) is not None:
                    break
            else:
                n, new = 1, w[i]
            out.append(new)
            i += n
        return out

    # each array is read once; a fold in the plan would look at the words anew at every place
    @F.pandas_udf("array<string>")
    def run(words: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else replaced(w.tolist(), x.tolist()) for w, x in zip(words, low, strict=True)], dtype=object)

    return run(words, F.transform(words, F.lower))


def _below_thousand(n: Column) -> Column:
    ones, tens = F.array(*(F.lit(w) for w in ONES)), F.array(*(F.lit(w) for w in TENS))
    rest = (n % 100).cast("int")
    small = F.when(rest == 0, None).when(rest < 20, F.get(ones, rest)).otherwise(F.concat(F.get(tens, F.floor(rest / 10).cast("int")), F.when(rest % 10 > 0, F.concat(F.lit("-"), F.get(ones, rest % 10))).otherwise("")))
    hundreds = F.when(n >= 100, F.concat(F.get(ones, F.floor(n / 100).cast("int")), F.lit(" hundred")))
    return F.concat_ws(" and ", hundreds, small)


def in_letters(word: Column) -> Column:
    """A word of 1 to 12 digits as English number words (one hundred and twenty-three); any other word as it is."""
    n = F.when(word.rlike("^[0-9]{1,12}$"), word.cast("long"))
    parts = []
    for k in reversed(range(len(SCALES))):
        group = F.floor(n / 1000**k) % 1000
        spelled = _below_thousand(group)
        parts.append(F.when(group > 0, F.concat(spelled, F.lit(f" {SCALES[k]}")) if k else spelled))
    # below a hundred, what follows thousands is joined by "and"
    tail = (n % 1000).between(1, 99) & (n >= 1000)
    head = F.concat_ws(" ", *parts[:-1])
    return F.when(n.isNull(), word).when(n == 0, ONES[0]).when(tail, F.concat(head, F.lit(" and "), parts[-1])).otherwise(F.concat_ws(" ", *parts))
