"""Pages written by hand after layouts that sites have, with their main text; none of them is a training page."""

PAGES = [
    # A blog: post and sidebar as nested boxes, comments below.
    ("""<html><head><title>Growing tomatoes</title></head><body class="home blog"><div id="page"><div id="masthead" class="site-header"><a href="/">The Kitchen Garden</a><p class="site-description">Notes from a small plot</p></div>
<div id="content" class="site-content"><div id="primary"><div class="post-42 post hentry"><h1 class="entry-title">Growing tomatoes on a balcony</h1><div class="entry-content"><p>Tomatoes need six hours of sun, a deep pot and steady water. I use pots of twenty litres.</p>
<p>Feed the plants every second week once the first truss has set. <strong>Do not</strong> wet the leaves.</p><ul><li>Pinch out side shoots of cordon varieties.</li><li>Leave bush varieties alone.</li></ul></div></div>
<div id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><p>Great advice, thank you so much!</p></li><li class="comment"><p>Mine always get blight in August.</p></li></ol></div></div>
<div id="secondary" class="widget-area sidebar"><h3>Recent posts</h3><ul><li><a href="/a">Sowing peas</a></li><li><a href="/b">Compost</a></li></ul></div></div><div class="site-footer">Proudly grown since 2009.</div></div></body></html>""",
     "Growing tomatoes on a balcony Tomatoes need six hours of sun, a deep pot and steady water. I use pots of twenty litres. Feed the plants every second week once the first truss has set. Do not wet the leaves. Pinch out side shoots of cordon varieties. Leave bush varieties alone."),
    # A table layout of the nineties.
    ("""<HTML><HEAD><TITLE>Lighthouses</TITLE></HEAD><BODY BGCOLOR=#FFFFFF><TABLE WIDTH=100%><TR><TD CLASS=menu WIDTH=150><A HREF=index.html>Home</A><BR><A HREF=links.html>Links</A><BR><A HREF=guest.html>Guestbook</A></TD>
<TD><H1>Lighthouses of the north coast</H1><P>The first tower was built of granite in 1811 and stands forty metres above the sea.<P>Its lamp burned whale oil until 1860, when a lens of the first order was installed.<P>Today the light is automatic and may be visited on Sundays in summer.</TD></TR></TABLE></BODY></HTML>""",
     "Lighthouses of the north coast The first tower was built of granite in 1811 and stands forty metres above the sea. Its lamp burned whale oil until 1860, when a lens of the first order was installed. Today the light is automatic and may be visited on Sundays in summer."),
    # A news page: notice first, live advert inside the story, related stories as a list.
    ("""<!doctype html><html><body><div class="cookie-banner" role="dialog"><p>We use cookies to improve your experience. By continuing you agree.</p><button>Accept</button></div><header><nav><ul><li><a href="/world">World</a></li><li><a href="/sport">Sport</a></li></ul></nav></header>
<main><article><h1>Council votes to keep ferry running</h1><p class="byline">By A. Writer</p><p>The council voted on Tuesday to keep the island ferry running through the winter, ending months of doubt.</p><div class="ad-slot"><p>Cheap flights from nine pounds! Book today.</p></div>
<p>Residents had warned that without the boat the school would close. "We are relieved," said the head teacher.</p><p>The subsidy will be reviewed in spring <span class="sponsored">Win a car now.</span> after a survey of users.</p></article></main>
<aside class="related"><h3>More stories</h3><ul><li><a href="/1">Bridge repairs begin</a></li><li><a href="/2">Storm warning issued</a></li></ul></aside><footer><p>Contact us. All rights reserved.</p></footer></body></html>""",
     "Council votes to keep ferry running The council voted on Tuesday to keep the island ferry running through the winter, ending months of doubt. Residents had warned that without the boat the school would close. \"We are relieved,\" said the head teacher. The subsidy will be reviewed in spring after a survey of users."),
    # Documentation with code.
    ("""<html><body><div class="sphinxsidebar"><h3>Contents</h3><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></div><div class="document"><div class="body" role="main"><h1>Reading files</h1><p>The reader opens a file and yields its rows one by one, so memory stays small.</p><pre>for row in reader(path):
    print(row)</pre><p>A missing file raises an error before the first row is read.</p></div></div><div class="footer">Built with a generator.</div></body></html>""",
     "Reading files The reader opens a file and yields its rows one by one, so memory stays small. for row in reader(path): print(row) A missing file raises an error before the first row is read."),
    # An encyclopedia article: infobox-like table, edit links, categories.
    ("""<html><body><div id="mw-navigation"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random article</a></li></ul></div><div id="content" class="mw-body" role="main"><h1 id="firstHeading">River otter</h1><div id="bodyContent"><p>The river otter is a semiaquatic mammal that lives along rivers and coasts. It eats fish, crayfish and frogs.</p><h2>Range</h2><p>Otters were once found across the whole continent. Hunting reduced their range in the last century.</p></div></div><div id="footer" role="contentinfo"><ul><li>This page was last edited in May.</li></ul></div></body></html>""",
     "River otter The river otter is a semiaquatic mammal that lives along rivers and coasts. It eats fish, crayfish and frogs. Range Otters were once found across the whole continent. Hunting reduced their range in the last century."),
    # A recipe, all in sections without names.
    ("""<html><body><header><a href="/">Suppers</a></header><section><h1>Leek soup</h1><p>A soup for cold evenings that takes half an hour and three leeks.</p><ol><li>Slice the leeks and soften them in butter.</li><li>Add potatoes and stock and simmer for twenty minutes.</li><li>Blend, season and serve with bread.</li></ol></section><form action="/join"><label>Get our letter</label><input name="mail"><p>No spam, ever.</p><button>Join</button></form><footer>Suppers, since 2015.</footer></body></html>""",
     "Leek soup A soup for cold evenings that takes half an hour and three leeks. Slice the leeks and soften them in butter. Add potatoes and stock and simmer for twenty minutes. Blend, season and serve with bread."),
    # Text in bare boxes with line breaks.
    ("""<html><body><div class="top"><a href="/">Poems</a> | <a href="/about">About</a> | <a href="/mail">Mail</a></div><div class="text"><h2>The mill</h2><div>The wheel turns slowly in the stream,<br>the miller sleeps, the sacks are full,<br>and flour dust lies on every beam.</div><div>Beyond the weir the herons stand and wait for evening, patient as the stones.</div></div><div class="copyright">Copyright by the author. Do not copy.</div></body></html>""",
     "The mill The wheel turns slowly in the stream, the miller sleeps, the sacks are full, and flour dust lies on every beam. Beyond the weir the herons stand and wait for evening, patient as the stones."),
    # An announcement with share buttons, tags and an unclosed button.
    ("""<html><body><nav class="navbar"><button class="toggle">Menu<a href="/">Home</a></nav><div class="container"><div class="article-body"><h1>Library opens new reading room</h1><p>The city library opened its new reading room on Monday after two years of building work.</p><p>It has eighty seats, step-free access and a quiet corner for children.</p></div><div class="share-buttons"><a href="#">Share</a><a href="#">Tweet</a></div><div class="tags"><a href="/t/library">library</a> <a href="/t/city">city</a></div></div><div class="newsletter-signup"><p>Subscribe to our weekly newsletter and never miss a story.</p></div></body></html>""",
     "Library opens new reading room The city library opened its new reading room on Monday after two years of building work. It has eighty seats, step-free access and a quiet corner for children."),
    # Questions and answers as a definition list, in German.
    ("""<html lang="de"><body><div id="kopf" class="header"><p>Stadtwerke</p></div><div id="inhalt" class="content"><h1>Häufige Fragen</h1><dl><dt>Wann wird der Zähler abgelesen?</dt><dd>Einmal im Jahr, meist im November. Sie erhalten vorher eine Karte.</dd><dt>Wie kündige ich?</dt><dd>Schriftlich mit einer Frist von vier Wochen zum Ende des Monats.</dd></dl></div><div class="footer"><a href="/impressum">Impressum</a> <a href="/datenschutz">Datenschutz</a></div></body></html>""",
     "Häufige Fragen Wann wird der Zähler abgelesen? Einmal im Jahr, meist im November. Sie erhalten vorher eine Karte. Wie kündige ich? Schriftlich mit einer Frist von vier Wochen zum Ende des Monats."),
    # A page whose story is not marked at all.
    ("""<html><body><ul class="menu"><li><a href="/1">News</a></li><li><a href="/2">Archive</a></li><li><a href="/3">Shop</a></li></ul><h1>On keeping bees</h1><p>Bees fly from about ten degrees on, and in a mild February you may see them at the crocuses.</p><p>Leave the hives shut until it is warm, and heft them now and then to feel how much food is left.</p><p>&copy; 2011 The beekeepers' club</p></body></html>""",
     "On keeping bees Bees fly from about ten degrees on, and in a mild February you may see them at the crocuses. Leave the hives shut until it is warm, and heft them now and then to feel how much food is left."),
]
