"""Labelled pages to fit and to test the page classifier on: made by rules from a seed, in three ways of marking up a page.

The ways are: landmark elements, class names on plain elements, and neither. Texts are invented words; every block's text is
its own, so that a label can be told by it.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba co di fe gu ha jo ki la me no pu ra se ti vo wa xe yo zu".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.labels: dict[str, bool] = {}

    def words(self, low: int, high: int) -> list[str]:
        word = lambda: "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))
        return [word() for _ in range(self.r.randint(low, high))]

    def told(self, text: str, content: bool) -> str:
        self.labels[text] = content
        return text

    def sentence(self, low: int, high: int) -> str:
        return " ".join(self.words(low, high)).capitalize() + self.r.choice(".....!?")

    def linked(self, text: str) -> str:
        return f'<a href="/{len(text)}">{text}</a>'

    def links(self, low: int, high: int) -> str:
        item = lambda: self.linked(self.told(" ".join(self.words(1, 4)).capitalize(), False))
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(self.r.randint(low, high))) + "</ul>"

    def stock(self) -> str:
        r = self.r
        rest = " ".join(self.words(1, 6))
        kinds = [f"We use cookies to {rest}.", f"Subscribe to our newsletter {rest}", f"Share {rest}", f"Log in to {rest}", f"Advertisement {rest}", f"Copyright 2020 {rest}. All rights reserved.", f"Related {rest}", self.sentence(4, 14)]
        return self.told(r.choice(kinds), False)

    def comment(self) -> str:
        return f"<p>{self.told(self.sentence(3, 30), False)}</p>"

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.9:
            out.append(f"<h1>{self.told(' '.join(self.words(2, 9)).capitalize(), True)}</h1>")
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.12:
                out.append(f"<h2>{self.told(' '.join(self.words(1, 5)).capitalize(), True)}</h2>")
            elif kind < 0.2:
                out.append("<ul>" + "".join(f"<li>{self.told(self.sentence(2, 10), True)}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.32:
                out.append(f"<p>{self.told(self.sentence(1, 3), True)}</p>")
            elif kind < 0.4:
                words = self.words(5, 12)
                text = self.told(" | ".join(words), True)
                out.append(f"<p>{text}</p>")
            else:
                text = self.told(" ".join(self.sentence(4, 18) for _ in range(r.randint(1, 5))), True)
                first, *rest = text.split(" ")
                out.append(f"<p>{r.choice([first, self.linked(first), f'<b>{first}</b>'])} {' '.join(rest)}</p>")
        return "".join(out)

    def page(self) -> str:
        way = self.r.choice(["landmarks", "names", "neither"])
        named = {
            "landmarks": {"menu": "nav", "head": "header", "side": "aside", "foot": "footer", "main": "article", "notice": "aside", "talk": 'section class="comments"', "form": "form"},
            "names": {"menu": 'div class="nav"', "head": 'div id="header"', "side": 'div class="sidebar"', "foot": 'div class="footer"', "main": 'div class="post content"', "notice": 'div class="cookie notice"', "talk": 'div id="comments"', "form": 'div class="signup"'},
            "neither": dict.fromkeys(["menu", "head", "side", "foot", "main", "notice", "talk", "form"], "div"),
        }[way]
        r = self.r

        def part(kind: str, body: str) -> str:
            tag = named[kind]
            return f"<{tag}>{body}</{tag.split()[0]}>"

        out = [part("head", f"<p>{self.stock()}</p>")] if r.random() < 0.5 else []
        out.append(part("menu", self.links(3, 8)))
        out += [part("notice", self.stock())] if r.random() < 0.5 else []
        out.append(part("main", self.article()))
        out += [part("form", f"{self.stock()} <input>")] if r.random() < 0.3 else []
        out += [part("talk", "".join(self.comment() for _ in range(r.randint(1, 4))))] if way != "neither" and r.random() < 0.4 else []
        out += [part("side", self.links(2, 6))] if r.random() < 0.5 else []
        out.append(part("foot", f"<p>{self.told('© ' + ' '.join(self.words(1, 6)), False)}</p>" + (self.links(1, 4) if r.random() < 0.5 else "")))
        return f"<html><head><title>{' '.join(self.words(1, 5))}</title><style>p{{}}</style></head><body>{''.join(out)}</body></html>"


def samples(n: int, seed: int = 0) -> list[tuple[str, dict[str, bool]]]:
    """``n`` pages, and for each whether a block's text is content. Texts that come twice with unlike labels have none."""
    out = []
    for i in range(n):
        w = _Writer(seed * 1_000_003 + i)
        out.append((w.page(), w.labels))
    return out
