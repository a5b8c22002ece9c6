"""Generated answers and first-token log-probabilities to labels and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import WS, strip, text_lines

UNKNOWN = "unknown"
TOKEN = f"[^{WS}.,!?:;()\\[\\]\"']+"
SOFT_FLOOR = 1e-10


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def drop_reasoning(col, ignore_case: bool = False) -> Column:
    """Answer without its <think> blocks, stripped."""
    flags = "(?si)" if ignore_case else "(?s)"
    return strip(F.regexp_replace(_c(col), f"{flags}<think>.*?</think>", ""))


def _mentions(text: Column, words: Sequence[str]) -> Column:
    """ASCII words match whole words, other scripts match anywhere."""
    tests = [
        text.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){w}(?:$|[^\p{{L}}\p{{N}}_])")
        if w.isascii()
        else text.contains(w)
        for w in words
    ]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _mention_label(text: Column, yes: Sequence[str], no: Sequence[str]) -> Column:
    return F.when(_mentions(text, yes), "1").when(_mentions(text, no), "0")


def _token_label(token: Column, yes: Sequence[str], no: Sequence[str]) -> Column:
    return F.when(token.isin(*yes), "1").when(token.isin(*no), "0")


def parse_yes_no(
    raw, reasoning: bool = False, yes: Sequence[str] = V.YES_WORDS, no: Sequence[str] = V.NO_WORDS
) -> Column:
    """"1", "0" or "unknown" from a generated answer.

    Direct mode: the first token decides, else a mention of yes before no. Reasoning
    mode: the first yes/no token of the last three lines read upwards, else the lowest
    line that mentions either.
    """
    text = F.lower(drop_reasoning(raw))
    if not reasoning:
        first = F.regexp_extract(text, TOKEN, 0)
        return F.coalesce(
            _token_label(first, yes, no), _mention_label(text, yes, no), F.lit(UNKNOWN)
        )
    upwards = F.reverse(text_lines(text))
    tail = F.array_join(F.slice(upwards, 1, 3), "\n")
    tokens = F.regexp_extract_all(tail, F.lit(f"({TOKEN})"), F.lit(1))
    decisive = F.filter(tokens, lambda t: t.isin(*yes, *no))
    labels = F.transform(upwards, lambda line: _mention_label(line, yes, no))
    first_line = F.get(F.filter(labels, lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(_token_label(F.get(decisive, F.lit(0)), yes, no), first_line, F.lit(UNKNOWN))


def parse_nli(raw, parse_last: bool = False, parse_yesno: bool = False) -> Column:
    """Entailment word gives "1", contradiction or neutral "0", else "unknown"."""
    entail, contra, neutral = V.NLI_LABELS
    text = drop_reasoning(raw)
    if parse_last:
        e, c, n = (last_start(text, w) for w in V.NLI_LABELS)
        other = F.greatest(c, n)
        return F.when((e > 0) & (e >= other), "1").when(other > 0, "0").otherwise(UNKNOWN)
    s_entail, s_contra, s_neutral = V.NLI_STEMS
    out = (
        F.when(text.contains(entail), "1")
        .when(text.contains(contra) | text.contains(neutral), "0")
        .when(text.contains(s_entail), "1")
        .when(text.contains(s_contra) | text.contains(s_neutral), "0")
    )
    if parse_yesno:
        out = out.when(text.startswith(V.YES_WORDS[1]), "1").when(
            text.startswith(V.NO_WORDS[1]), "0"
        )
    return out.otherwise(UNKNOWN)


def last_start(text: Column, word: str) -> Column:
    """1-based start of the last occurrence of ``word``, 0 if absent."""
    pos = F.instr(F.reverse(text), word[::-1])
    return F.when(pos > 0, F.length(text) - pos - len(word) + 2).otherwise(0)


def normalise_prediction(raw, labels: Sequence[str] = V.NLI_LABELS) -> Column:
    """Exact label, else the first listed label contained in the answer, else the answer."""
    text = drop_reasoning(raw, ignore_case=True)
    out = F.when(text.isin(*labels), text)
    for label in labels:
        out = out.when(text.contains(label), F.lit(label))
    return out.otherwise(text)


def _mass(logprobs: Column, ids: Sequence[str]) -> Column:
    """Summed probability of the tokens in ``ids``."""
    hit = F.map_filter(logprobs, lambda k, _: k.isin(*ids)) if ids else None
    if hit is None:
        return F.lit(0.0)
    return F.aggregate(F.map_values(hit), F.lit(0.0), lambda acc, v: acc + F.exp(v))


def soft_yes_no(logprobs, yes_ids: Sequence[str], no_ids: Sequence[str]) -> Column:
    """Share of yes in the yes/no mass of a token -> logprob map; 0.5 without any mass."""
    m = _c(logprobs)
    yes = _mass(m, yes_ids)
    both = yes + _mass(m, [i for i in no_ids if i not in set(yes_ids)])
    return F.when(both > SOFT_FLOOR, yes / both).otherwise(0.5)


def unambiguous_ids(*groups: Sequence[str]) -> list[list[str]]:
    """Each group without the ids any other group claims too."""
    sets = [set(g) for g in groups]
    return [
        sorted(s - set().union(*[o for j, o in enumerate(sets) if j != i]))
        for i, s in enumerate(sets)
    ]


def soft_entailment(logprobs, entail, contra, neutral) -> Column:
    """Entailment share of the three-way mass, over unambiguous ids."""
    e_ids, c_ids, n_ids = unambiguous_ids(entail, contra, neutral)
    m = _c(logprobs)
    e = _mass(m, e_ids)
    return e / (e + _mass(m, c_ids) + _mass(m, n_ids) + SOFT_FLOOR)


def label_id(col, labels: Sequence[str] = V.NLI_LABELS) -> Column:
    """Position of a label in the label list, -1 if it is not listed."""
    pairs = [x for i, name in enumerate(labels) for x in (F.lit(name), F.lit(i))]
    return F.coalesce(F.element_at(F.create_map(*pairs), _c(col)), F.lit(-1))
