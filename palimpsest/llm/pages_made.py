"""Seeded pages with known main text, on which the block labeller is trained.

Every part of a page is drawn from many layouts: the words of all parts come from the same invented vocabulary, so
that what tells them apart is where they stand and, some of the time, the usual words of menus and notices.
"""

from __future__ import annotations

import random
import re

# Usual names of page parts, and usual words of parts that are not the article.
ARTICLE = "article|main|div class=content|div id=content|div class=post-body|div class=entry-content|div class=article-body|section class=story|div class=article|div itemprop=articleBody|div class=main-content|div role=main|section class=post|div class=text|td class=body|div class=post|div class=prose|div class=markdown-body|div class=story-copy|div class=blog-entry"
MENU = "nav|div class=nav|div id=menu|ul class=menu|div class=navbar|nav class=main-nav|div role=navigation|div class=breadcrumbs|ol class=breadcrumb|nav class=pagination|div class=pager|div class=toc|div class=navigation|div class=dropdown|ul class=topnav"
HEADER = "header|div id=header|div class=site-header|header class=masthead|div class=top-bar|div class=banner|header role=banner|div class=logo"
FOOTER = "footer|div id=footer|div class=site-footer|footer class=page-footer|div class=copyright|div role=contentinfo|div class=bottom|div class=legal|footer id=colophon"
SIDE = "aside|div id=sidebar|div class=sidebar|aside class=related|div class=widget|div class=related-posts|section class=recommended|div class=popular|div class=author-box|div class=tags|div role=complementary|div class=share|div class=social|div class=rail|div class=trending"
NOTICE = "div class=cookie-notice|div id=cookie-banner|div class=notice|div class=alert|div class=consent|div class=gdpr|div role=alert|div class=popup|div class=modal|dialog|div class=announcement|div class=paywall|div class=message|section class=privacy|div class=overlay|div class=toast|div class=cookies"
ADVERT = "div class=ad|div class=ads|div class=advert|div id=ad-1|div class=advertisement|div class=sponsored|aside class=promo|div class=ad-slot|section class=sponsor|div class=promotion|ins class=adsbygoogle|div class=banner-ad|p class=ad"
FORM = "form|form class=search|form id=subscribe|div class=newsletter|form class=login|fieldset|div class=signup|form class=contact|div class=subscribe"
COMMENT = "div id=comments|section class=comments|div class=comment-list|ol class=commentlist|div id=disqus-thread|section id=comments|div class=comment|div class=discussion|div class=responses|ul class=replies|div class=user-comments|div class=reviews|div class=feedback"
LIST = "ul ol".split()
#: Names that say nothing of the part.
BLANK = "wide box block c1 row clearfix wrapper container page site layout root app inner col grid section module".split()


def known_words() -> list[str]:
    """The words of all usual names, in order: what the labeller may know a part by."""
    names = "|".join((ARTICLE, MENU, HEADER, FOOTER, SIDE, NOTICE, ADVERT, FORM, COMMENT)).split("|")
    values = [n.partition("=")[2] for n in names]
    return sorted({w.lower() for v in values for w in re.split(r"[\s-]+|(?<=[a-z])(?=[A-Z])", v) if w and not w.isdigit()})


SAYS = {
    "menu": "Home|About|Contact|News|Sports|Login|Sign in|Next|Previous|Archive|Categories|Blog|Products|Services|Menu|Skip to content",
    "header": "Welcome|Daily|Search|Menu|Log in|The",
    "footer": "Copyright|All rights reserved|Privacy policy|Terms of use|Contact us|Powered by|Imprint",
    "side": "Related articles|Popular|Read more|Tags|About the author|Share|Follow us|Trending|You may also like|Recent posts",
    "notice": "We use cookies|Accept|Decline|Privacy settings|By continuing|This site uses cookies|Subscribe to continue reading|Update your browser",
    "ad": "Advertisement|Sponsored|Buy now|Sale|Click here|Special offer|Ad",
    "form": "Email|Name|Subscribe|Submit|Search|Password|Sign up|Your message|Send|Newsletter",
    "comment": "Reply|says|Comments|Leave a comment|Posted by|Anonymous|1 hour ago|Report|Like",
}


class Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        r = self.rng
        parts = [a + b for a in "b c d f g l m n p r s t v qu ch th st é ü ñ".split() for b in "a e i o u an er on ti es".split()]
        self.words = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(600)]
        self.strange = False  # whether this page's names say nothing

    def prose(self, low: int, high: int) -> str:
        r, out, n = self.rng, [], self.rng.randint(low, high)
        noise = r.random() < 0.08
        while n > 0:
            size = min(n, r.randint(1, 16))
            words = [r.choice(self.words) + (r.choice(["###", "***", "$$$", "%%%", "&amp;&amp;"]) if noise else "") for _ in range(size)]
            out.append(" ".join(words).capitalize() + r.choice(["."] * 8 + ["?", "!", "", ":"]))
            n -= size
        text = " ".join(out)
        if r.random() < 0.15:
            text = text.replace(" ", r.choice([" &amp; ", " &quot;", "&nbsp;", " &#8212; ", "\n  "]), 1)
        if r.random() < 0.15:
            words = text.split(" ")
            k = r.randrange(len(words))
            words[k] = r.choice([f"<b>{words[k]}</b>", f"<i>{words[k]}</i>", f'<a href="/x">{words[k]}</a>', f"<span>{words[k]}</span>", f"{words[k]}<br>"])
            text = " ".join(words)
        return text

    def short(self, kind: str) -> str:
        r = self.rng
        return r.choice(SAYS[kind].split("|")) if r.random() < 0.5 else " ".join(r.choice(self.words) for _ in range(r.randint(1, 4)))

    def wrap(self, kinds: str, inner: str) -> str:
        name = self.rng.choice(kinds.split("|"))
        tag, _, attr = name.partition(" ")
        if self.strange:
            attr = self.rng.choice(["", f'class="{self.token()}"', f'class="{self.token()} {self.rng.choice(BLANK)}"', f'id="{self.token()}"'])
            return f"<{tag}{' ' * bool(attr)}{attr}>{inner}</{tag}>"
        if attr:
            key, _, value = attr.partition("=")
            if self.rng.random() < 0.2:
                value += " " + self.rng.choice(BLANK)
            attr = f' {key}="{value}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def token(self) -> str:
        """A name that says nothing: c7, x-k3f, css-1a2b3c or an invented word."""
        r = self.rng
        return r.choice([f"{r.choice('cxbst')}{r.randint(1, 99)}", "css-" + "".join(r.choices("abcdef0123456789", k=6)), r.choice(self.words), r.choice(BLANK)])

    def entries(self, kind: str, n: int) -> str:
        tag = self.rng.choice(["ul", "ul", "ol", "div", "span", "p"])
        link = self.rng.random() < 0.8
        one = [f'<a href="/{k}">{self.short(kind)}</a>' if link else self.short(kind) for k in range(n)]
        if tag in LIST:
            return f"<{tag}>" + "".join(f"<li>{x}</li>" for x in one) + f"</{tag}>"
        return "".join(f"<{tag}>{x}</{tag}>" for x in one) if tag != "span" else " | ".join(one)

    def other(self, kind: str, names: str) -> str:
        """A part that is not the article: links, short words or whole paragraphs of prose.

        Where names say nothing, prose stands only in elements that say it, or beside words that do.
        """
        r, inner = self.rng, ""
        told = not self.strange
        if self.strange:
            usual = {"menu": "nav|nav|div|ul", "header": "header|header|div", "footer": "footer|footer|div", "side": "aside|aside|div", "notice": "div|dialog", "ad": "aside|div|ins", "form": "form"}[kind]
            names = usual
        if kind == "footer" and r.random() < 0.4:
            inner = f"{r.choice(['&copy;', '(c)', 'Copyright', '&copy; 2024'])} {self.token()}.example.net {r.choice(['&middot;', '|', '-', ''])} {self.prose(2, 25)}"
        for _ in range(0 if inner and r.random() < 0.7 else r.randint(1, 3)):
            roll = r.random()
            if roll < 0.35 or (not told and roll < 0.6):
                inner += self.entries(kind, r.randint(1, 8))
            elif roll < 0.55:
                inner += self.prose(2, 30) if told else r.choice(SAYS[kind].split("|")) + " " + self.prose(1, 8)
            elif roll < 0.8:
                inner += "".join(f"<p>{self.prose(3, 40) if told else r.choice(SAYS[kind].split('|')) + ' ' + self.prose(1, 10)}</p>" for _ in range(r.randint(1, 3)))
            elif roll < 0.9:
                inner += f"<h3>{self.short(kind)}</h3>{self.entries(kind, r.randint(1, 4))}"
            else:
                inner += f"<div>{self.short(kind)}</div>"
        return self.wrap(names, inner)

    def form(self) -> str:
        r = self.rng
        inner = "".join(f"<label>{self.short('form')}</label><input name=x>" for _ in range(r.randint(0, 3)))
        inner += r.choice(["", f"<p>{self.prose(3, 25)}</p>", self.prose(2, 12)]) + f"<button>{self.short('form')}</button>"
        return self.wrap("form|form|fieldset" if self.strange else FORM, inner)

    def comments(self) -> str:
        r, inner = self.rng, r"" if self.rng.random() < 0.4 else f"<h3>{self.short('comment')}</h3>"
        for _ in range(r.randint(1, 5)):
            body = f"<p>{self.prose(3, 60)}</p>" * (r.random() < 0.8) or self.prose(3, 60)
            who = r.choice(["", f"<b>{self.short('comment')}</b>", f'<div class="author">{self.short("comment")}</div>'])
            inner += r.choice(['<div class="comment">{}</div>', "<li>{}</li>", "<div>{}</div>", "<article>{}</article>", '<article class="comment">{}</article>']).format(who + body)
        if self.strange:
            inner = f"<h3>{r.choice(['Comments', '3 comments', 'Leave a comment', 'Discussion', 'Responses'])}</h3>" + inner
            return self.wrap("div|section|ol|ul", inner)
        return self.wrap(COMMENT, inner)

    def mark(self, text: str) -> str:
        """A piece of the article: its text carries a mark that the trainer looks for and removes."""
        return "\x02" + text

    def pieces(self) -> str:
        """One element of an article's body."""
        r = self.rng
        roll, short = r.random(), r.random() < 0.2
        text = self.mark(self.prose(1, 4) if short else self.prose(5, 90))
        if roll < 0.62:
            return f"<p>{text}</p>" if r.random() < 0.85 else f"<p>{text}"
        if roll < 0.72:
            items = "".join(f"<li>{x}{'</li>' * (r.random() < 0.8)}" for x in (self.item() for _ in range(r.randint(1, 7))))
            return "<{0}>".format(t := r.choice(LIST)) + items + f"</{t}>"
        if roll < 0.75:
            return f"<blockquote>{text}</blockquote>" if r.random() < 0.5 else f"<blockquote><p>{text}</p></blockquote>"
        if roll < 0.80:
            return f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{self.mark(self.prose(1, 8))}</{h}><p>{text}</p>"
        if roll < 0.83:
            return f"<div>{text}</div>"
        if roll < 0.87:
            rows = "".join("<tr>" + "".join(f"<td>{self.mark(self.prose(1, 6))}</td>" for _ in range(r.randint(1, 4))) + "</tr>" for _ in range(r.randint(1, 4)))
            head = r.choice(["", f"<thead><tr><th>{self.mark(self.prose(1, 2))}</th></tr></thead>"])
            return f"<table>{head}<tbody>{rows}</tbody></table>" if r.random() < 0.5 else f"<table>{rows}</table>"
        if roll < 0.90:
            return f"<pre>{self.mark(self.code())}</pre>" if r.random() < 0.5 else f"<pre><code>{self.mark(self.code())}</code></pre>"
        if roll < 0.92:
            return "<dl>" + "".join(f"<dt>{self.mark(self.prose(1, 3))}</dt><dd>{self.mark(self.prose(2, 20))}</dd>" for _ in range(r.randint(1, 4))) + "</dl>"
        if roll < 0.94:
            return f"<figure><img src=x><figcaption>{text}</figcaption></figure>"
        if roll < 0.96:
            return f"<section><p>{text}</p></section>"
        return f"<div><div><p>{text}</p></div></div>"

    def item(self) -> str:
        r = self.rng
        text = self.mark(self.prose(1, 20))
        return r.choice([text, text, f"<p>{text}</p>", f'<a href="/r">{text}</a>' if r.random() < 0.3 else text])

    def code(self) -> str:
        r = self.rng
        return "\n".join(r.choice(["", "  ", "    "]) + " ".join(r.choice([*self.words[:40], "=", "(x)", "{", "}", "return", "0;", "#"]) for _ in range(r.randint(1, 8))) for _ in range(r.randint(1, 8)))

    def inside(self) -> str:
        """A part that is no article although an article holds it."""
        r = self.rng
        return r.choice([lambda: self.other("ad", ADVERT), lambda: self.wrap(ADVERT, self.prose(3, 14)) if not self.strange else self.other("ad", ADVERT), lambda: self.other("side", SIDE), lambda: self.other("side", "aside|aside class=related"), self.form, lambda: self.other("notice", NOTICE), lambda: self.other("menu", MENU)])()

    def article(self) -> str:
        r, out = self.rng, []
        if r.random() < 0.8:
            head = self.mark(self.prose(2, 12))
            out.append(r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>", '<h1 class="title">{}</h1>']).format(head))
            if r.random() < 0.12:
                by = self.mark(r.choice(["By ", "by ", ""]) + self.prose(1, 3))
                out.append(r.choice(["<p class=byline>{}</p>", "<p>{}</p>", "<div class=meta>{}</div>", "<address>{}</address>"]).format(by))
        if r.random() < 0.3:
            out.append(f"<p><b>{self.mark(self.prose(1, 30))}<br>")
        many = r.choice([1, 2, 3, 5, 8, 13])
        for k in range(many):
            out.append(self.pieces())
            if r.random() < 0.09:
                out.append(self.inside())
                out.append(self.pieces() if r.random() < 0.8 else "")
        if r.random() < 0.15:
            out.append(self.comments())
        inner = "".join(out)
        if self.strange:
            roll = r.random()
            if roll < 0.15:
                return inner
            return self.wrap("article|main|section" if roll < 0.4 else "div|div|div|section|td" if roll < 0.95 else "center", inner)
        return self.wrap("article" if r.random() < 0.35 else ARTICLE, inner)

    def page(self) -> str:
        r = self.rng
        self.strange = r.random() < 0.35
        before = [(0.6, lambda: self.other("menu", MENU)), (0.4, lambda: self.other("header", HEADER)), (0.4, lambda: self.other("ad", ADVERT)),
                  (0.25, lambda: self.other("notice", NOTICE)), (0.15, self.form), (0.15, lambda: self.other("side", SIDE))]
        after = [(0.45, lambda: self.other("side", SIDE)), (0.4, self.comments), (0.25, self.form), (0.3, lambda: self.other("ad", ADVERT)),
                 (0.2, lambda: self.other("notice", NOTICE)), (0.15, lambda: self.other("menu", MENU))]
        r.shuffle(before)
        r.shuffle(after)
        top = "".join(f() for p, f in before if r.random() < p)
        body = self.article() if r.random() < 0.97 else ""
        end = "".join(f() for p, f in after if r.random() < p)
        if r.random() < 0.75:
            end += self.other("footer", FOOTER)
        inner = top + body + end
        roll = r.random()
        if roll < 0.06:
            inner = body  # nothing but the article
        elif roll < 0.12:  # laid out as a table
            links = r.choice(["", "<ul>"]) + r.choice(["<br>", " | ", " ", "<li>"]).join(f'<a href="/{k}">{self.short("menu")}</a>' for k in range(r.randint(1, 8)))
            cells = [f"<td>{links}</td>", f"<td{' class=' + r.choice(['body', 'main', 'content', 'text']) if r.random() < 0.5 else ''}>{body}</td>"]
            inner = "<table>" + r.choice(["", f"<tr><td>{self.short('header')}</td></tr>"]) + "<tr>" + "".join(cells) + "</tr></table>" + end
        if r.random() < 0.4:
            inner = f'<div class="{r.choice(["wrapper", "container", "page", "site", "layout"])}">{inner}</div>'
        if r.random() < 0.2:
            inner = f'<div id="{r.choice(["root", "app", "page"])}">{inner}</div>'
        return f"<html><head><title>x</title></head><body>{inner}" + r.choice(["</body></html>", "", "</body>"])
