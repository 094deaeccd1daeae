"""The tree of data categories as a table: (name, parent, path, depth)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The categories of data, nested as a compact list.
DEFAULT = """
root:
- physical measurement:
  - gas content:
    - partial pressure:
      - partial pressure of carbon dioxide
      - end-tidal partial pressure of carbon dioxide
    - gas percentage:
      - fraction inspired oxygen
      - carbon dioxide percentage
      - end-tidal carbon dioxide percentage
  - pressure:
    - pressure relative to atmospheric pressure:
      - airway pressure:
        - P0.1
        - mean airway pressure
        - plateau pressure
        - positive end-expiratory pressure:
          - total positive end-expiratory pressure
          - intrinsic positive end-expiratory pressure
        - peak inspiratory pressure
        - negative inspiratory pressure
      - gastric pressure
      - pleural pressure
    - relative pressure:
      - transpulmonary pressure
      - transdiaphragmatic pressure
    - pressure difference
  - impedance:
    - absolute impedance
    - relative impedance
    - impedance difference
  - volume:
    - absolute volume:
      - end-expiratory lung volume
      - end-inspiratory lung volume
      - functional residual capacity
      - dead space volume
    - volume difference:
      - tidal volume:
        - inspiratory tidal volume:
          - mandatory inspiratory tidal volume
          - spontaneous inspiratory tidal volume
        - expiratory tidal volume:
          - mandatory expiratory tidal volume
          - spontaneous expiratory tidal volume
        - mean of inspiratory and expiratory tidal volume
        - mandatory tidal volume
        - spontaneous tidal volume
      - change in end-expiratory lung volume
      - trapped volume
    - minute volume:
      - mandatory minute volume
      - spontaneous minute volume
      - leak minute volume
  - flow:
    - airflow
    - bloodflow:
      - cardiac output
    - gas flow:
      - carbon dioxide flow
  - compliance:
    - lung compliance
    - thoracic wall compliance
  - elastance:
    - lung elastance
    - thoracic wall elastance
  - resistance:
    - airway resistance
  - duration:
    - inspiratory time:
      - spontaneous inspiratory time
      - mandatory inspiratory time
    - expiratoory time:
      - mandatory expiratory time
      - spontaneous expiratory time
    - time at low pressure
  - rate:
    - respiratory rate:
      - mandatory respiratory rate
      - spontaneous respiratory rate
    - heart rate
  - temperature:
    - airway temperature
  - time constant
- calculated value:
  - index:
    - rapid shallow breathing index
  - ratio:
    - leak percentage
    - percentage of spontaneous minute volume
    - inspiratory to expiratory ratio:
      - spontaneous inspiratory to expiratory ratio
      - mandatory inspiratory to expiratory ratio
    - percentage dead space of expiratory tidal volume
    - ratio between upper 20% pressure range and total dynamic compliance
- other
"""

Node = tuple[str, str | None, list[str], int]
_LINE = re.compile(r"( *)(?:(-) +)?([^:#]+?)\s*(:?)\s*\Z")


def checked(nodes: list[Node]) -> list[Node]:
    """The nodes; a name that occurs twice is an error."""
    seen: set[str] = set()
    for name, *_ in nodes:
        if name in seen:
            raise ValueError(f"category names must be unique, {name!r} is not")
        seen.add(name)
    return nodes


def compact(text: str) -> list[Node]:
    """Nodes of a compact list in YAML: a root with a colon, below it ``- name`` lines, those with children with a colon, nested by indentation."""
    nodes: list[Node] = []
    above: list[tuple[int, str, bool]] = []  # indentation, name and whether it may have children, of the open nodes
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = _LINE.match(line)
        if m is None or (m[2] is None) != (not nodes):
            raise ValueError(f"a line is no category: {line!r}")
        depth = len(m[1]) + (m[2] is not None)
        while above and above[-1][0] >= depth:
            above.pop()
        if nodes and (not above or not above[-1][2]):
            raise ValueError(f"a category stands below none: {line!r}")
        nodes.append((m[3], above[-1][1] if above else None, [*(a[1] for a in above), m[3]], len(above)))
        above.append((depth, m[3], bool(m[4])))
    return checked(nodes)


def nested(tree: dict, parent: str | None = None, path: tuple[str, ...] = ()) -> list[Node]:
    """Nodes of a dictionary: names with dictionaries or lists of what is below, or one node with ``name`` and ``children``."""
    if "name" in tree and isinstance(tree["name"], str):
        here = (*path, tree["name"])
        out: list[Node] = [(tree["name"], parent, list(here), len(path))]
        for child in tree.get("children", ()):
            out += nested(child, tree["name"], here)
    else:
        out = []
        for name, below in tree.items():
            here = (*path, name)
            out.append((name, parent, list(here), len(path)))
            for child in [below] if isinstance(below, dict) else below or ():
                out += nested({child: None} if isinstance(child, str) else child, name, here)
    return out if path else checked(out)


def categories(spark: SparkSession, nodes: list[Node] | None = None) -> DataFrame:
    """The tree as a table, the default one unless nodes are given."""
    return spark.createDataFrame(compact(DEFAULT) if nodes is None else nodes, "name string, parent string, path array<string>, depth int")


def within(path: Column, category: str) -> Column:
    """Whether a node is a category or below it."""
    return F.array_contains(path, category)


def check(name: str, category: str, *, raise_: bool = False, nodes: list[Node] | None = None) -> bool:
    """Whether ``name`` is ``category`` or below it; an unknown category raises."""
    paths = {n[0]: n[2] for n in (compact(DEFAULT) if nodes is None else nodes)}
    if category not in paths:
        raise ValueError(f"unknown category {category!r}")
    found = category in paths.get(name, [])
    if raise_ and not found:
        raise ValueError(f"{name!r} is not within {category!r}")
    return found


def of_category(data: DataFrame, category: str, *, column: str = "category", nodes: list[Node] | None = None) -> DataFrame:
    """The rows whose category is a given one or below it; an unknown category raises."""
    every = compact(DEFAULT) if nodes is None else nodes
    if category not in {n[0] for n in every}:
        raise ValueError(f"unknown category {category!r}")
    return data.where(F.col(column).isin([n[0] for n in every if category in n[2]]))
