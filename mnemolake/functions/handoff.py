"""Hand-off states of tasks: one canonical form for whatever a caller gives, and a text for prompts."""

from __future__ import annotations

import json
import re
import urllib.parse

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of texts and lists, and the headings of a rendered state, most important first.
OBJECTIVE_CHARS, ITEM_CHARS, MOST_ITEMS = 500, 400, 30
OBJECTIVE = "Objetivo: "
HEADINGS = {
    "facts": "Hechos establecidos",
    "deadEnds": "Callejones sin salida (no repetir)",
    "plan": "Plan restante",
    "changes": "Cambios aplicados",
    "verification": "Verificación",
}
_BLANK = re.compile(r"\s+")


def key_of(agent: str, task: str) -> str:
    """The id of a task's state; no two pairs of agent and task share one."""
    if not (agent and task):
        raise ValueError("a task state needs an agent and a task")
    return ":".join(urllib.parse.quote(part, safe="") for part in (agent, task))


def key_column(agent: str, task: str) -> Column:
    """key_of as an expression over columns; null where either is empty."""
    parts = [F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")) for c in (agent, task)]
    return F.when((F.length(agent) > 0) & (F.length(task) > 0), F.concat(parts[0], F.lit(":"), parts[1]))


def _line(value: object, most: int) -> str:
    """A value as one line: texts as they are, other values as JSON, nothing for null."""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False) if value is not None else ""
    return _BLANK.sub(" ", text).strip()[:most]


def canonical(objective: object, lists: dict[str, object]) -> dict:
    """The objective and every list of HEADINGS. A list given as one text is one item; what is neither text nor list counts as none; blanks go."""
    out: dict = {"objective": _line(objective, OBJECTIVE_CHARS)}
    for name in HEADINGS:
        given = lists.get(name)
        items = given if isinstance(given, (list, tuple)) else [given] * isinstance(given, str)
        lines = (_line(x, ITEM_CHARS) for x in items)
        out[name] = list(filter(None, lines))[:MOST_ITEMS]
    return out


def render(state: dict, most: int | None = None) -> str:
    """A state for a prompt, most important first, so that cutting its end loses least."""
    parts = [OBJECTIVE + state["objective"]] if state.get("objective") else []
    for name, heading in HEADINGS.items():
        if state.get(name):
            parts.append("\n- ".join([f"{heading}:", *state[name]]))
    return "\n\n".join(parts)[: None if most is None else max(0, most)]
