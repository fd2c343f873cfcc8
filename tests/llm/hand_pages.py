"""Pages written by hand in layouts the training generator doesn't make, and the blocks of their main text."""

PAGES = [
    (  # a table layout of old, no element says what it is
        """<HTML><HEAD><TITLE>Gardens</TITLE></HEAD><BODY BGCOLOR=white><TABLE WIDTH="100%"><TR><TD COLSPAN=2><FONT SIZE=5>Garden Notes</FONT></TD></TR>
        <TR><TD CLASS=leftnav><A HREF="/a">Home</A><BR><A HREF="/b">Roses</A><BR><A HREF="/c">Ferns</A></TD>
        <TD CLASS=maintext><H1>Why ferns like the north wall</H1><P>Ferns grow where the soil stays damp and the sun comes late in the day.
        <P>Plant them in April, a hand apart, and water them twice a week until the roots have taken hold.<SCRIPT>ad()</SCRIPT>
        <UL><LI>Shade from noon on is better than shade all day.<LI>Leaf mould keeps the roots cool.</UL></TD></TR></TABLE><DIV CLASS=footer>&copy; 1999 Garden Notes</DIV></BODY></HTML>""",
        ["Why ferns like the north wall", "Ferns grow where the soil stays damp and the sun comes late in the day.",
         "Plant them in April, a hand apart, and water them twice a week until the roots have taken hold.",
         "Shade from noon on is better than shade all day.", "Leaf mould keeps the roots cool."],
    ),
    (  # a blog with utility classes and custom elements
        """<!doctype html><html><body><site-banner class="flex px-4 banner"><p>We use small files on your device to remember you.</p><button>Fine</button></site-banner>
        <header class="flex justify-between"><a href="/">The Slow Kitchen</a><nav class="hidden md:block"><a href="/r">Recipes</a> <a href="/s">Shop</a></nav></header>
        <main class="max-w-prose mx-auto"><h1 class="text-4xl">Bread without kneading</h1><p class="lead">Time does the work that arms would do: the dough rests for a night and a day.</p>
        <svg viewBox="0 0 1 1" /><p>Mix <math><mn>500</mn><mi>g</mi></math> of flour with salt, yeast and water; then leave it alone.</p><pre>flour  500
water  350</pre>
        <aside class="callout"><p>Get a letter from us each week with three recipes.</p></aside><h2>Baking</h2><p>Heat the pot with the oven. İt must be hot before the dough goes in.</p></main>
        <section id="comments"><h3>Two replies</h3><article class="comment"><p>I tried this with rye and it was wonderful, thank you so much for it.</p></article></section><footer><p>Made slowly since 2011</p></footer></body></html>""",
        ["Bread without kneading", "Time does the work that arms would do: the dough rests for a night and a day.",
         "Mix 500g of flour with salt, yeast and water; then leave it alone.", "flour 500 water 350", "Baking", "Heat the pot with the oven. İt must be hot before the dough goes in."],
    ),
    (  # news, the article split by parts of other kinds
        """<html><body><div id="topbar"><a href="/l">Log in</a></div><div class="breadcrumb"><a href="/n">News</a> &gt; <a href="/c">City</a></div>
        <div class="story-wrap"><article itemscope><header><h1>Bridge to open a month late</h1><p class="byline">By A. Writer</p></header><div class="story-body"><p>The new bridge over the harbour will open in May and not in April, the council said on Monday.</p>
        <div class="ad-slot"><p>Buy two pairs of shoes and pay for one.</p></div><p>Paint on the northern arch had not dried in the wet spring, a speaker said.</p><div class="related-links"><ul><li><a href="/1">Harbour tolls rise</a></li><li><a href="/2">Ferry sold</a></li></ul></div>
        <blockquote><p>&#8220;We would rather be late than sorry.&#8221;</p></blockquote><p>Walkers may cross from this weekend on.</p></div></article></div><div class="cookie-bar"><p>This site stores cookies. Read more or accept them all.</p></div><div class="sidebar-right"><h4>Most read</h4><p>Ten walks for the autumn</p></div></body></html>""",
        ["The new bridge over the harbour will open in May and not in April, the council said on Monday.",
         "Paint on the northern arch had not dried in the wet spring, a speaker said.", "“We would rather be late than sorry.”", "Walkers may cross from this weekend on."],
    ),
    (  # documentation, definition lists, text after unclosed tags
        """<html lang=de><body><div role=navigation><ul><li><a href=a>Start</a><li><a href=b>Befehle</a></ul></div><div role=main><h1>Der Befehl sort</h1><p>Ordnet die Zeilen einer Datei.<dl><dt>-r<dd>kehrt die Ordnung um.<dt>-n<dd>ordnet nach Zahlen.</dl>
        <form action=/s><label>Suche</label><input name=q><button>Los</button></form><p>Ohne Datei liest er die Eingabe.</div><div role=contentinfo>Stand: gestern</div></body></html>""",
        ["Der Befehl sort", "Ordnet die Zeilen einer Datei.", "-r", "kehrt die Ordnung um.", "-n", "ordnet nach Zahlen.", "Ohne Datei liest er die Eingabe."],
    ),
    (  # a forum without any article element
        """<html><body><div class="nav-top"><a href="/f">Forum</a> <a href="/m">Members</a></div><div class="content"><h2>How do I bleed a radiator?</h2><div class="post-text"><p>The upper half stays cold however long the heating runs. Which valve do I open, and how far?</p><p>It is an old one with a square key.</p></div></div>
        <div class="comments"><ol class="commentlist"><li><p>Turn off the pump first, then a quarter turn to the left until water comes.</p><li><p>Have a cloth ready.</p></ol></div><div class="share"><a href="/t">Share</a></div><div class="page-footer"><p>All times are local.</p></div></body></html>""",
        ["How do I bleed a radiator?", "The upper half stays cold however long the heating runs. Which valve do I open, and how far?", "It is an old one with a square key."],
    ),
]
