"""Labelled pages to train on, put together from parts in many layouts."""

from __future__ import annotations

import random

from .html_crf import blocks

_ON, _OFF = "\ue000", "\ue001"  # marks of the label, in each text that is made
_SYLLABLES = "an ter lo ri men ta el so ver du ka ni pra st ong ea ich ette ura mi".split()
_BODY = ('<article>', '<main>', '<main><article>', '<div class="content">', '<div id="content">', '<div class="post">', '<div class="entry-content">', '<section class="story">', '<div id="main"><div class="article-body">', '<div class="wrap"><article class="post">', '<div>', '<article class="entry">')
_PARTS = {
    "menu": ('<nav><ul>{li}</ul></nav>', '<div class="nav">{a}</div>', '<ul class="menu">{li}</ul>', '<div id="navigation"><ul>{li}</ul></div>', '<div class="breadcrumbs">{a}</div>', '<nav>{a}</nav>'),
    "header": ('<header><h1>{s}</h1>{a}</header>', '<div class="header"><p>{s}</p></div>', '<header><p>{t}</p></header>', '<div id="masthead">{s}</div>', '<header>{s}</header>'),
    "advert": ('<div class="ad">{t}</div>', '<div class="ads"><p>{t}</p></div>', '<aside class="advert">{t}</aside>', '<div class="sponsored"><a href="/x">{s}</a><p>{t}</p></div>', '<div class="promo">{t}</div>', '<div id="ad-top">{t}</div>'),
    "notice": ('<div class="cookie">{t}</div>', '<div class="cookie-notice"><p>{t}</p><button>{s}</button></div>', '<div class="notice">{t}</div>', '<div id="consent" role="dialog"><p>{t}</p></div>', '<div class="newsletter"><p>{t}</p></div>', '<noscript>{t}</noscript>', '<dialog><p>{t}</p></dialog>', '<div class="banner">{t}</div>'),
    "side": ('<aside><h2>{s}</h2><ul>{li}</ul></aside>', '<div class="sidebar"><h3>{s}</h3><p>{t}</p></div>', '<aside><p>{t}</p><p>{t}</p></aside>', '<div class="related"><ul>{li}</ul></div>', '<div id="sidebar"><div class="widget">{t}</div></div>'),
    "form": ('<form><label>{s}</label><input name="q"><button>{s}</button></form>', '<form action="/s"><p>{t}</p><select><option>{s}<option>{s}</select></form>', '<div class="search"><form><p>{s}</p></form></div>', '<form>{t}</form>'),
    "comment": ('<section class="comments"><h2>{s}</h2><p>{t}</p><p>{t}</p></section>', '<div id="comments"><div class="comment"><p>{t}</p></div><div class="comment"><p>{t}</p></div></div>', '<ol class="commentlist"><li><p>{t}</p><li><p>{t}</p></ol>', '<div class="comments"><article class="comment"><p>{t}</p></article></div>', '<section id="comments"><article><p>{t}</p></article></section>'),
    "share": ('<div class="share">{a}</div>', '<ul class="social">{li}</ul>', '<div class="share-buttons"><a href="/f">{s}</a></div>'),
    "footer": ('<footer>&copy; {s}</footer>', '<footer><p>{t}</p>{a}</footer>', '<div class="footer"><p>{t}</p></div>', '<div id="footer">{t}<ul>{li}</ul></div>', '<footer>{t}</footer>', '<div class="copyright">&copy; {s}</div>'),
}


def _text(r: random.Random, n: int) -> str:
    words = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    for k in range(0, n, r.randint(4, 15)):
        words[k] = words[k].capitalize()
    shape = r.random()
    if shape < 0.06:
        words = [w.upper() + "!!" for w in words]
    elif shape < 0.12:
        words = [w + r.choice(("***", "&amp;&amp;", "%%%", "$$$")) for w in words]
    elif shape < 0.16:
        words = " | ".join(words).split()
    return " ".join(words) + (r.choice(".!?") if r.random() < 0.75 else "")


def _fill(r: random.Random, part: str) -> str:
    while "{" in part:
        part = part.replace("{t}", _OFF + _text(r, r.randint(3, 60)), 1) if "{t}" in part else part
        part = part.replace("{s}", _OFF + _text(r, r.randint(1, 4)), 1)
        part = part.replace("{li}", "".join(f'<li><a href="/{k}">{_OFF}{_text(r, r.randint(1, 3))}</a></li>' for k in range(r.randint(2, 7))), 1)
        part = part.replace("{a}", " ".join(f'<a href="/{k}">{_OFF}{_text(r, r.randint(1, 3))}</a>' for k in range(r.randint(2, 7))), 1)
    return part


def _part(r: random.Random, *names: str) -> str:
    return _fill(r, r.choice(_PARTS[r.choice(names)]))


def _body(r: random.Random) -> str:
    on = lambda n: _ON + _text(r, n)
    parts = []
    if r.random() < 0.8:
        parts.append(f"<h1>{on(r.randint(1, 12))}</h1>")
        if r.random() < 0.15:
            parts[-1] = f"<header>{parts[-1]}</header>".replace(_ON, _OFF)
    for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
        x = r.random()
        n = r.choice((1, 2, 4, 8, 15, 30, 60, 90))
        if x < 0.62:
            parts.append(f"<p>{on(n)}{r.choice(('</p>', '</p>', '', '<br>'))}")
        elif x < 0.7:
            parts.append(f"<p><b>{on(n)}<br>")
        elif x < 0.76:
            parts.append(f"<{(h := r.choice(('h2', 'h3')))}>{on(r.randint(1, 8))}</{h}>")
        elif x < 0.82:
            parts.append("<ul>" + "".join(f"<li>{on(r.randint(1, 20))}" for _ in range(r.randint(1, 5))) + "</ul>")
        elif x < 0.86:
            parts.append(f"<blockquote><p>{on(n)}</p></blockquote>")
        elif x < 0.89:
            parts.append(f'<p>{on(n)} <a href="/l">{_text(r, 2)}</a> {_text(r, 3)}</p>')
        elif x < 0.92:
            parts.append(f"<table><tr><td>{on(2)}</td><td>{on(2)}</td></tr></table>")
        elif x < 0.95:
            parts.append(f'<figure><img src="i.png"><figcaption>{on(r.randint(2, 12))}</figcaption></figure>')
        else:
            parts.append(f"<div>{on(n)}</div>")
        if r.random() < 0.12:
            parts.append(_part(r, "advert", "share", "form", "side", "notice"))
    if r.random() < 0.15:
        parts.append(_part(r, "comment", "share"))
    return "".join(parts)


def _page(r: random.Random) -> str:
    start = r.choice(_BODY)
    ends = "".join(f"</{t.split()[0].strip('<>')}>" for t in reversed(start.replace("><", ">|<").split("|")))
    before = [_part(r, name) for name in ("notice", "header", "menu", "form", "advert", "side") if r.random() < 0.5]
    after = [_part(r, name) for name in ("share", "comment", "advert", "side", "form", "menu", "notice") if r.random() < 0.35]
    r.shuffle(before)
    foot = _part(r, "footer") if r.random() < 0.85 else ""
    return f"<html><head><title>x</title></head><body>{''.join(before)}{start}{_body(r)}{ends}{''.join(after)}{foot}</body></html>"


def labelled_pages(n: int, seed: int = 8) -> list[tuple[list[tuple], list[int]]]:
    """Blocks and labels of ``n`` pages, the same ones each time."""
    out = []
    for k in range(n):
        page = blocks(_page(random.Random(seed * 1_000_003 + k)))
        clean = [(p, t.replace(_ON, "").replace(_OFF, ""), links) for p, t, links in page]
        out.append((clean, [int(_ON in t) for _, t, _ in page]))
    return out


def labelled_html(n: int, seed: int) -> list[tuple[str, str]]:
    """Pages and their main texts, to test with."""
    out = []
    for k in range(n):
        html = _page(random.Random(seed * 1_000_003 + k))
        want = " ".join(t.replace(_ON, "") for _, t, _ in blocks(html) if _ON in t)
        out.append((html.replace(_ON, "").replace(_OFF, ""), want))
    return out
