"""Mathematics in lines: which spans, which regions, and their text in three notations.

A region's text depends on the sizes and heights of all of its spans, so conversion is a small
function over the line's span array, run by an Arrow UDF."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..config import MathConfig

# LaTeX names of symbols.
LATEX = {
    "α": "\\alpha", "β": "\\beta", "γ": "\\gamma", "δ": "\\delta", "ε": "\\epsilon", "ζ": "\\zeta", "η": "\\eta", "θ": "\\theta",
    "ι": "\\iota", "κ": "\\kappa", "λ": "\\lambda", "μ": "\\mu", "ν": "\\nu", "ξ": "\\xi", "π": "\\pi", "ρ": "\\rho",
    "σ": "\\sigma", "τ": "\\tau", "υ": "\\upsilon", "φ": "\\phi", "χ": "\\chi", "ψ": "\\psi", "ω": "\\omega",
    "Γ": "\\Gamma", "Δ": "\\Delta", "Θ": "\\Theta", "Λ": "\\Lambda", "Ξ": "\\Xi", "Π": "\\Pi", "Σ": "\\Sigma", "Φ": "\\Phi", "Ψ": "\\Psi", "Ω": "\\Omega",
    "±": "\\pm", "∓": "\\mp", "×": "\\times", "÷": "\\div", "·": "\\cdot", "∗": "\\ast", "∘": "\\circ", "∑": "\\sum", "∏": "\\prod", "∫": "\\int",
    "∂": "\\partial", "∇": "\\nabla", "√": "\\sqrt",
    "≤": "\\leq", "≥": "\\geq", "≠": "\\neq", "≈": "\\approx", "≡": "\\equiv", "∝": "\\propto",
    "∈": "\\in", "∉": "\\notin", "⊂": "\\subset", "⊃": "\\supset", "⊆": "\\subseteq", "⊇": "\\supseteq", "∪": "\\cup", "∩": "\\cap",
    "→": "\\to", "←": "\\leftarrow", "↔": "\\leftrightarrow", "⇒": "\\Rightarrow", "⇐": "\\Leftarrow", "⇔": "\\Leftrightarrow",
    "∞": "\\infty", "∅": "\\emptyset", "∀": "\\forall", "∃": "\\exists", "¬": "\\neg", "∧": "\\land", "∨": "\\lor",
}
# Further characters that make a span mathematics.
MORE_SYMBOLS = "∀∃∄∅∆∇∈∉∋∌∎∏∐∑−∓∔∕∖∗∘∙√∛∜∝∞∟∠∡≤≥≦≧≨≩≪≫≬≭"
# Raised and lowered forms.
RAISED = str.maketrans("0123456789ni+-=()", "⁰¹²³⁴⁵⁶⁷⁸⁹ⁿⁱ⁺⁻⁼⁽⁾")
LOWERED = str.maketrans("0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎")
SYMBOLS = frozenset(LATEX) | frozenset(MORE_SYMBOLS)
_FONT = re.compile(r"^CM[A-Z]|MATH|SYMBOL|^MT|STIX")
_CM = re.compile(r"^CM[A-Z]")
SMALL = 0.85


def is_math_span(span, extra: tuple[str, ...] = ()) -> bool:
    font = (span["font_name"] or "").upper()
    return bool(_FONT.search(font)) or any(x.upper() in font for x in extra) or not SYMBOLS.isdisjoint(span["text"])


def regions(spans: list, extra: tuple[str, ...] = ()) -> list[tuple[bool, list]]:
    """Runs (is mathematics, spans) of a line in order."""
    out: list[tuple[bool, list]] = []
    for s in spans:
        m = is_math_span(s, extra)
        if out and out[-1][0] == m:
            out[-1][1].append(s)
        else:
            out.append((m, [s]))
    return out


def script(span, spans: list, threshold: float) -> int:
    """1 raised, -1 lowered, 0 on the line."""
    base = max(s["font_size"] for s in spans)
    if span["font_size"] >= base * SMALL:
        return 0
    floor = min((s["bottom"] for s in spans if s["font_size"] >= base * SMALL), default=span["bottom"])
    rise = span["bottom"] - floor
    return (rise > base * threshold) - (rise < -(base * threshold))


def to_latex(spans: list, threshold: float = 0.3) -> str:
    out = ""
    for s in spans:
        t = "".join(LATEX[c] + " " if c in LATEX else c for c in s["text"]).strip()
        k = script(s, spans, threshold)
        if k:
            out += ("^{" if k > 0 else "_{") + t + "}"
        else:
            out += (" " if out and t and out[-1].isalnum() and t[0].isalnum() else "") + t
    return out


def to_unicode(spans: list, threshold: float = 0.3) -> str:
    return "".join(s["text"].translate((None, RAISED, LOWERED)[k]) if (k := script(s, spans, threshold)) else s["text"] for s in spans)


def to_plain(spans: list, threshold: float = 0.3) -> str:
    out = ""
    for s in spans:
        t = "".join(LATEX[c].lstrip("\\") if c in LATEX else c for c in s["text"])
        k = script(s, spans, threshold)
        out += f"{'^' if k > 0 else '_'}({t})" if k else t
    return out


def convert(spans: list, cfg: MathConfig) -> str:
    kind = cfg.representation
    if kind == "auto":
        kind = "latex" if any(_CM.search((s["font_name"] or "").upper()) for s in spans) else "unicode"
    return {"latex": to_latex, "unicode": to_unicode, "plain": to_plain}[kind](spans, cfg.script_threshold)


def delimited(text: str, display: bool, number: str | None, cfg: MathConfig) -> str:
    if not display:
        return cfg.inline[0] + text + cfg.inline[1]
    tag = f" \\tag{{{number.strip('()')}}}" if number else ""
    return cfg.display[0] + text + tag + cfg.display[1]


def escape(text: str, markdown: bool) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("](", "]\\(") if markdown else text


def render_line(spans: list, cfg: MathConfig, markdown: bool) -> str:
    """Spans joined without spaces, mathematics converted and never escaped."""
    runs = regions(spans, cfg.extra_fonts)
    whole = len(runs) == 1
    return "".join(delimited(convert(r, cfg), whole, None, cfg) if m else escape("".join(s["text"] for s in r), markdown) for m, r in runs)


def render_block(text: str | None, lines, cfg: MathConfig, markdown: bool) -> str | None:
    out = "\n".join(render_line(list(x["spans"] or []), cfg, markdown) for x in lines or [])
    return out or escape(text or "", markdown)


def render_block_udf(cfg: MathConfig, markdown: bool):
    return F.udf(lambda text, lines: render_block(text, lines, cfg, markdown), "string", useArrow=True)


def display_equations(spans: list, left: float, right: float, page_width: float, extra: tuple[str, ...] = ()) -> bool:
    """Is the line mathematics alone, near the middle of the page?"""
    return bool(spans) and all(is_math_span(s, extra) for s in spans) and abs((left + right) / 2 - page_width / 2) < page_width * 0.15


def equation_number(spans: list) -> str | None:
    for t in (spans[-1]["text"], "".join(s["text"] for s in spans)) if spans else ():
        m = re.search(r"\(([^(]*)\)$", t.strip())
        if m and m[1] and len(m[1].encode()) <= 10 and all(c.isalnum() or c == "." for c in m[1]):
            return f"({m[1]})"
    return None
