"""Reports as text, from rows that the driver holds already: flow charts, tables, macros, and the package of a study."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

from pyspark.sql import DataFrame

#: Characters that LaTeX reads as commands.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
TIME = (1980, 1, 1, 0, 0, 0)


def latex(text: str) -> str:
    return "".join(LATEX.get(c, c) for c in text)


def mermaid(text: str) -> str:
    return text.replace('"', "#quot;").replace("\n", "<br/>")


def number(value: float, places: int = 0) -> str:
    """A number with points for thousands and a comma for decimals."""
    return f"{value:,.{places}f}".translate(str.maketrans({",": ".", ".": ","}))


def markdown_table(rows: DataFrame, most: int = 200) -> str:
    """The first rows of a small table."""
    names = rows.columns
    lines = [f"| {' | '.join(names)} |", f"|{'-|' * len(names)}"]
    lines += [f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows.limit(most).collect()]
    return "\n".join(lines)


def latex_table(rows: DataFrame, most: int = 200) -> str:
    head = " & ".join(map(latex, rows.columns)) + r" \\"
    body = [" & ".join("" if v is None else latex(str(v)) for v in r) + r" \\" for r in rows.limit(most).collect()]
    return "\n".join([r"\begin{tabular}{" + "l" * len(rows.columns) + "}", head, r"\hline", *body, r"\end{tabular}"])


def macros(values: dict[str, object]) -> str:
    """LaTeX commands of values: names of letters alone."""
    return "\n".join(rf"\newcommand{{\{''.join(c for c in k if c.isalpha())}}}{{{latex(str(v))}}}" for k, v in sorted(values.items()))


def flow_chart(stages: list[tuple[str, int]], kind: str = "mermaid") -> str:
    """A chart of stages and their counts, as Mermaid, TikZ or a Markdown list."""
    if kind == "mermaid":
        nodes = [f'  s{i}["{mermaid(n)}: {c}"]' for i, (n, c) in enumerate(stages)]
        return "\n".join(["flowchart TD", *nodes, *(f"  s{i} --> s{i + 1}" for i in range(len(stages) - 1))])
    if kind == "tikz":
        nodes = [rf"\node (s{i}) at (0,-{2 * i}) {{{latex(n)}: {c}}};" for i, (n, c) in enumerate(stages)]
        return "\n".join([r"\begin{tikzpicture}", *nodes, *(rf"\draw[->] (s{i}) -- (s{i + 1});" for i in range(len(stages) - 1)), r"\end{tikzpicture}"])
    return "\n".join(f"- {n}: {c}" for n, c in stages)


def package(files: dict[str, str | bytes]) -> bytes:
    """A zip with fixed times and a list of checksums: the same files give the same bytes."""
    out, data = io.BytesIO(), {k: v.encode() if isinstance(v, str) else v for k, v in files.items()}
    data["SHA256SUMS"] = "".join(f"{hashlib.sha256(v).hexdigest()}  {k}\n" for k, v in sorted(data.items())).encode()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(data):
            z.writestr(zipfile.ZipInfo(name, TIME), data[name])
    return out.getvalue()


def opened(content: bytes, suffix: str) -> tuple[list[dict], int]:
    """JSON lines of a package's file with the shortest path that ends so, and the number of lines that don't parse."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if n.endswith(suffix)), key=lambda n: (len(n), n))
        text = z.read(names[0]).decode("utf-8-sig") if names else ""
    rows, bad = [], 0
    for line in text.split("\n"):
        if line.strip():
            try:
                rows.append(json.loads(line))
            except ValueError:
                bad += 1
    return rows, bad


def manifest(runs: dict) -> str:
    """A run's manifest as JSON with sorted keys; saved after each partition, it says what a resumed run may skip."""
    return json.dumps(runs, sort_keys=True, ensure_ascii=False, indent=1, default=str)
