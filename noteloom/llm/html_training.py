"""Generated pages of known structure for the page extractor.

A page is a random layout: wrappers, an article of headings, paragraphs, lists, quotes and tables, and
boilerplate around and within it, with named, vague or meaningless attributes. Every element carries its
state in an attribute that only ``training_set`` reads.
"""

from __future__ import annotations

import random
import re

import numpy as np

#: Pages with boilerplate and a wrapped article, and pages whose content stands in the body or in one wrapper, with little about it or nothing.
PAGES, BARE = 1000, 700
# Names of page parts in other languages, and short or pieced-together ones, by the part they name.
OTHER_NAMES = {
    "nav": "navigation hauptmenue navi menue menu-principal barre-navigation navegacion menu-lateral menyu nawigacja navigazione gnb lnb tnav",
    "header": "kopf kopfzeile seitenkopf entete en-tete bandeau cabecera encabezado testata naglowek hdr pghead sitehdr",
    "footer": "fuss fusszeile seitenfuss impressum pied pied-page pie pie-pagina rodape stopka ftr pgfoot sitebtm",
    "ad": "werbung anzeige reklame publicite pub annonce publicidad anuncio patrocinado reklama pubblicita advt dfp-box mpu",
    "notice": "hinweis meldung datenschutz einwilligung avis bandeau-cookies consentement aviso consentimiento galletas powiadomienie ciasteczka ckbar optin",
    "side": "seitenleiste randspalte marginalspalte barre-laterale colonne-droite barra-lateral columna lateral kolumna rcol lcol mostread verwandt similaires relacionados",
    "form": "suche suchfeld anmeldung recherche connexion buscar busqueda formulario szukaj srch lgn",
    "share": "teilen folgen partager suivre compartir seguir udostepnij shr soc",
    "comments": "kommentare kommentar meinungen leserbriefe commentaires reponses avis-lecteurs comentarios respuestas opiniones komentarze cmts ugc talkback",
    "content": "inhalt beitrag artikel haupttext contenu corps texte billet contenido articulo cuerpo noticia tresc artykul maintxt bodytxt storycopy",
}
_SEED = 20_240_601
_MARK = re.compile(r" data-s=\"(\d)\"")


class _Maker:
    def __init__(self, rng: random.Random):
        self.r = rng
        self.plain = rng.random() < 0.3  # attributes say nothing
        self.semantic = rng.random() < 0.65  # HTML5 elements
        self.upper = rng.random() < 0.05
        self.noise = rng.choice(["", "", "", "", "!!", "###"])
        self.caps = rng.random() < 0.5
        self.other = 0.8 if rng.random() < 0.4 else 0.0  # share of attributes with names in OTHER_NAMES

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        out = ["".join(r.choice(["th", "an", "er", "é", "ou", "sch", "in", "ción", "ra", "st", "ö", "el", "日", "т"]) for _ in range(r.choice([1, 1, 2, 2, 3, 4]))) for _ in range(r.randint(lo, hi))]
        if self.upper:
            out = [w.upper() + self.noise for w in out]
        elif self.noise == "###" and r.random() < 0.5:
            out = [w + "###" for w in out]
        return " ".join(out)

    def sentence(self, lo: int = 3, hi: int = 16) -> str:
        w = self.words(lo, hi).split()
        for i in range(4, len(w), 7):
            if self.r.random() < 0.5:
                w[i] += ","
        return (" ".join(w)).capitalize() + "."

    def prose(self, lo: int, hi: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(lo, hi)))

    def attrs(self, *names: str, p: float = 0.9, part: str = "") -> str:
        r = self.r
        if r.random() > p:
            return ""
        name = f"c{r.randint(1, 99)}" if self.plain else self.name(names, part)
        if r.random() < 0.3:
            name += r.choice([" clearfix", " row", " col-8", " container", " block", " u-mt"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def el(self, tag: str, state: int, inner: str, attrs: str = "") -> str:
        return f'<{tag}{attrs} data-s="{state}">{inner}</{tag}>'

    def link(self) -> str:
        return f'<a href="/x">{self.words(1, 4)}</a>'

    def links(self, state: int = 2) -> str:
        items = "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(2, 9)))
        return self.el("ul", state, items, self.attrs("menu", "nav-list", "links", p=0.3, part="nav"))

    # boilerplate
    def nav(self) -> str:
        return self.el("nav" if self.semantic else "div", 2, self.links() if self.r.random() < 0.8 else " | ".join(self.link() for _ in range(6)), self.attrs("nav", "navbar", "main-menu", "breadcrumb", "pagination", p=0.5 if self.semantic else 0.95, part="nav"))

    def header(self) -> str:
        inner = self.el("h1" if self.r.random() < 0.3 else "div", 2, self.words(1, 4), self.attrs("logo", "site-title", "branding", part="header")) + (self.nav() if self.r.random() < 0.5 else self.el("p", 2, self.words(2, 8)))
        return self.el("header" if self.semantic else "div", 2, inner, self.attrs("header", "site-header", "masthead", "top", p=0.6 if self.semantic else 1, part="header"))

    def footer(self) -> str:
        r = self.r
        inner = r.choice(["&copy; ", "", "2024 "]) + f"{self.words(1, 2)} &middot; " + self.prose(1, 3)
        if r.random() < 0.5:
            inner = self.el("p", 2, inner) + (self.links() if r.random() < 0.4 else "")
        return self.el("footer" if self.semantic else "div", 2, inner, self.attrs("footer", "site-footer", "copyright", "bottom", p=0.3 if self.semantic else 1, part="footer"))

    def ad(self) -> str:
        inner = self.prose(1, 3) if self.r.random() < 0.7 else self.el("p", 2, self.prose(1, 2)) + self.link()
        return self.el(self.r.choice(["div", "div", "section", "aside", "ins", "p"]), 2, inner, " " + self.attrs_strict("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement", "banner-ad", part="ad"))

    def name(self, names: tuple[str, ...], part: str) -> str:
        return self.r.choice(OTHER_NAMES[part].split()) if part and self.r.random() < self.other else self.r.choice(names)

    def attrs_strict(self, *names: str, part: str = "") -> str:
        return f'{self.r.choice(["class", "class", "id"])}="{self.name(names, part)}"'

    def notice(self) -> str:
        inner = self.el("p", 2, self.prose(1, 3)) + (f"<button>{self.words(1, 2)}</button>" if self.r.random() < 0.7 else "")
        return self.el(self.r.choice(["div", "div", "section", "aside", "p"]), 2, inner if self.r.random() < 0.7 else self.prose(1, 2), " " + self.attrs_strict("cookie", "cookie-notice", "consent", "alert", "newsletter", "popup", "gdpr-banner", "notice", "subscribe", "paywall", part="notice"))

    def side(self) -> str:
        r = self.r
        body = "".join(r.choice([self.links, lambda: self.el("p", 2, self.prose(1, 3)), lambda: self.el("h3", 2, self.words(1, 4)), self.ad])() for _ in range(r.randint(1, 4)))
        return self.el("aside" if self.semantic else "div", 2, body, self.attrs("sidebar", "related", "widget", "side", "recommended", "trending", p=0.5 if self.semantic else 1, part="side"))

    def form(self) -> str:
        inner = "".join(f"<label>{self.words(1, 3)}</label><input type=text>" for _ in range(self.r.randint(1, 4))) + f"<button>{self.words(1, 2)}</button>"
        return self.el("form", 2, self.el("p", 2, inner) if self.r.random() < 0.4 else inner, self.attrs("search", "login", "contact", "signup", p=0.5, part="form"))

    def share(self) -> str:
        return self.el("div", 2, " ".join(self.link() for _ in range(3)), " " + self.attrs_strict("share", "social", "share-buttons", "follow-us", part="share"))

    def comments(self) -> str:
        r = self.r
        one = lambda: self.el(r.choice(["div", "li", "article"]), 2, (self.el("b", 2, self.words(1, 2), ' class="author"') if r.random() < 0.4 else self.words(1, 2)) + self.el("p", 2, self.prose(1, 4)), self.attrs("comment", "reply", "comment-body", p=0.8, part="comments"))
        inner = self.el("h3", 2, self.words(1, 3)) * (r.random() < 0.6) + "".join(one() for _ in range(r.randint(1, 6)))
        return self.el(r.choice(["div", "section", "ol", "ul"]), 2, inner, " " + self.attrs_strict("comments", "comment-list", "disqus_thread", "discussion", "replies", "respond", part="comments"))

    # content
    def para(self) -> str:
        r = self.r
        text = self.prose(1, r.choice([1, 3, 6, 10]))
        if r.random() < 0.3:
            w = text.split()
            k = r.randrange(len(w))
            w[k] = r.choice([f"<b>{w[k]}</b>", f"<em>{w[k]}</em>", f'<a href="/y">{w[k]}</a>', f"<span>{w[k]}</span>"])
            text = " ".join(w)
        if r.random() < 0.05:
            text = self.words(1, 3)
        return self.el("p", 1, text, self.attrs("text", "lead", "paragraph", p=0.05))

    def content(self) -> str:
        r = self.r
        n = r.choice([1, 1, 2, 3, 4, 6, 9])
        made = []
        if r.random() < 0.8:
            h1 = self.el("h1", 1, self.words(1, 10), self.attrs("title", "entry-title", "headline", p=0.25))
            made.append(self.el("header", 1, h1, self.attrs("entry-header", "article-header", p=0.3)) if r.random() < 0.12 else h1)
        for _ in range(n):
            k = r.random()
            if k < 0.72:
                made.append(self.para())
            elif k < 0.8:
                made.append(self.el(r.choice(["h2", "h3"]), 1, self.words(1, 8)))
            elif k < 0.87:
                made.append(self.el(r.choice(["ul", "ol"]), 1, "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(2, 5)))))
            elif k < 0.91:
                made.append(self.el("blockquote", 1, self.para() if r.random() < 0.5 else self.prose(1, 2)))
            elif k < 0.95:
                made.append(self.el("table", 1, "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(3))))
            elif k < 0.96:
                made.append(self.el("pre", 1, self.words(4, 20)))
            elif k < 0.97:
                made.append(self.details())
            else:
                made.append(self.el("figure", 1, "<img src=x>" + self.el("figcaption", 1, self.sentence())))
        for maker, p in ((self.ad, 0.15), (self.share, 0.1), (self.notice, 0.08), (self.comments, 0.08), (self.side, 0.07), (self.form, 0.06)):
            if r.random() < p:
                made.insert(r.randint(1, len(made)), maker())
        if r.random() < 0.3:
            k = r.randint(0, len(made) - 1)
            made = [*made[:k], self.el(r.choice(["div", "section"]), 1, "".join(made[k:]), self.attrs("body", "text", "section", "entry-content", p=0.4))]
        return "".join(made)

    def page(self) -> str:
        r = self.r
        if self.semantic:
            core = self.el("article", 1, self.content(), self.attrs("article", "post", "hentry", p=0.3, part="content"))
            if r.random() < 0.35:
                core = self.el("main", 0, core, self.attrs("main", "content", p=0.3, part="content"))
        else:
            core = self.el(r.choice(["div", "div", "section", "main"]), 1, self.content(), self.attrs("content", "post", "article-body", "main-content", "entry", "story", "text", p=0.9, part="content"))
        core_and = [core]
        if r.random() < 0.3:
            core_and.insert(r.randint(0, 1), self.side())
        if r.random() < 0.25:
            core_and.append(self.comments())
        if r.random() < 0.4:
            core_and = [self.el("div", 0, "".join(core_and), self.attrs("wrapper", "container", "page", "layout", "site", p=0.8))]
        for maker, p in ((self.ad, 0.35), (self.header, 0.35), (self.nav, 0.7), (self.notice, 0.25), (self.form, 0.15)):
            if r.random() < p:
                core_and.insert(0, maker())
        for maker, p in ((self.comments, 0.12), (self.side, 0.2), (self.ad, 0.15), (self.form, 0.1), (self.notice, 0.15), (self.footer, 0.8)):
            if r.random() < p:
                core_and.append(maker())
        body = "".join(core_and)
        if r.random() < 0.25:
            body = self.el("div", 0, body, self.attrs("wrapper", "page", "site", "root", p=0.7))
        return f'<html><head><title>{self.words(1, 5)}</title></head><body data-s="0">{body}</body></html>'


    def bare(self) -> str:
        """Content right in the body, in one wrapper, or without even a body."""
        r = self.r
        k = r.random()
        if k < 0.25:
            made = [self.el("h1", 1, self.words(1, 6))] * (r.random() < 0.5) + [self.el("p", 1, self.prose(1, r.choice([1, 1, 2, 4]))) for _ in range(r.randint(1, 4))]
        elif k < 0.4:
            made = [self.el("p", 1, self.words(1, 3)) for _ in range(r.randint(1, 6))]
            if r.random() < 0.5:
                made.insert(0, self.el(r.choice(["h1", "h2"]), 1, self.words(1, 4)))
        else:
            made = [self.content()]
        if r.random() < 0.2:
            made.insert(r.randint(0, len(made)), self.details())
        core = "".join(made)
        if r.random() < 0.3:
            core = self.el(r.choice(["div", "main", "section", "article"]), 1, core, self.attrs("content", "text", "page", "wrapper", p=0.5))
        for maker, p in ((self.nav, 0.2), (self.header, 0.1), (self.notice, 0.08)):
            if r.random() < p:
                core = maker() + core
        for maker, p in ((self.footer, 0.2), (self.comments, 0.08), (self.ad, 0.08)):
            if r.random() < p:
                core += maker()
        return core if r.random() < 0.3 else f'<html><body data-s="0">{core}</body></html>'

    def details(self) -> str:
        return self.el("details", 1, self.el("summary", 1, self.words(1, 6)) + (self.para() if self.r.random() < 0.7 else self.prose(1, 3)))


def made_page(rng: random.Random) -> str:
    """A generated page with the state of each element in data-s."""
    return _Maker(rng).page()


def bare_page(rng: random.Random) -> str:
    """A generated page with hardly anything about its content."""
    return _Maker(rng).bare()


def training_set(pages: int = PAGES, seed: int = _SEED, bare: int = BARE) -> tuple[np.ndarray, np.ndarray]:
    """(features, states) of the nodes of generated pages."""
    from noteloom.llm.dom import parse
    from noteloom.llm.html_extract import node_features

    rng = random.Random(seed)
    xs, ys = [], []
    for k in range(pages + bare):
        marked = made_page(rng) if k < pages else bare_page(rng)
        states: list[int] = []
        # the parser meets elements in the order of their marks; a probe attribute tells which become nodes
        numbered = _MARK.sub(lambda m: (states.append(int(m[1])) or f' itemprop="zz{"q" * len(states)}"'), marked)
        probe, _ = parse(numbered)
        clean, _ = parse(_MARK.sub("", marked))
        y = {}
        kept = []
        for v in probe:
            own = [w for w in v.words if w.startswith("zzq")]
            kept.append(states[len(own[0]) - 3] if own else 0)
        if len(probe) == len(clean):
            y = kept
        else:  # elements that are nodes only for the probe are left out
            y = _aligned(probe, kept, clean)
        xs.append(node_features(clean))
        ys.append(np.array(y))
    return np.concatenate(xs), np.concatenate(ys)


def _aligned(probe, kept: list[int], clean) -> list[int]:
    out, j = [], 0
    for v in clean:
        bare = v.words
        while not (probe[j].tag == v.tag and [w for w in probe[j].words if not w.startswith("zzq")] == bare):
            j += 1
        out.append(kept[j])
        j += 1
    return out
