"""Pages written by hand, of other shapes than those that the labeller is trained on: (page, blocks of its article)."""

PAGES = [
    (
        """<!doctype html><html lang="en-US"><head><title>Bread | The Slow Kitchen</title><link rel=stylesheet href=a.css></head><body class="single post-template">
<div id="page"><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">The Slow Kitchen</a></p><p class="site-description">Food that takes its time</p></div>
<nav id="site-navigation"><ul class="menu"><li><a href="/">Home</a></li><li><a href="/recipes">Recipes</a></li><li><a href="/about">About me</a></li></ul></nav></header>
<main id="main"><article class="post"><header class="entry-header"><h1 class="entry-title">A loaf for patient people</h1></header>
<div class="entry-content"><p>Most of the work in this bread is waiting. The dough rests overnight in a cool place, and by morning it has doubled.</p>
<p>You need flour, water, salt and a spoon of starter. Nothing else goes in, not even sugar.</p><h2>What you need</h2><ul><li>500 g of strong flour</li><li>350 g of water</li><li>10 g of salt</li></ul>
<p>Mix everything, fold it three times in the first hour, then leave it alone.</p></div></article>
<div id="comments" class="comments-area"><h2>2 thoughts on this post</h2><ol class="comment-list"><li class="comment"><p>Made this twice, the crust is wonderful!</p></li><li class="comment"><p>Can I use rye instead?</p></li></ol></div></main>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">Soup in January</a></li><li><a href="/2">On salt</a></li></ul></section></aside>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by flour. All rights reserved.</div></footer></div></body></html>""",
        ["A loaf for patient people", "Most of the work in this bread is waiting. The dough rests overnight in a cool place, and by morning it has doubled.", "You need flour, water, salt and a spoon of starter. Nothing else goes in, not even sugar.", "What you need", "500 g of strong flour", "350 g of water", "10 g of salt", "Mix everything, fold it three times in the first hour, then leave it alone."],
    ),
    (
        """<HTML><HEAD><TITLE>Sundials</TITLE></HEAD><BODY BGCOLOR="#FFFFFF"><H1>How a sundial is set</H1><P>A sundial has to be set for the latitude of the place where it stands. The gnomon points to the pole.
<P>First find true north, which is not where the compass points. Then raise the gnomon by as many degrees as the latitude has.
<P>In summer the shadow is short at noon; in winter it is long, and the hours lie closer together.</BODY></HTML>""",
        ["How a sundial is set", "A sundial has to be set for the latitude of the place where it stands. The gnomon points to the pole.", "First find true north, which is not where the compass points. Then raise the gnomon by as many degrees as the latitude has.", "In summer the shadow is short at noon; in winter it is long, and the hours lie closer together."],
    ),
    (
        """<html><head><meta charset=utf-8><title>Council approves new bridge</title><body><div class="top-bar"><a href="/login">Log in</a> <a href="/subscribe">Subscribe</a></div>
<nav class="main-nav"><a href="/politics">Politics</a><a href="/sport">Sport</a><a href="/culture">Culture</a></nav>
<div class="article-wrapper"><article><h1>Council approves new bridge over the river</h1><p>The city council voted on Tuesday evening to build a second bridge, after eleven years of argument about where it should stand.</p>
<aside class="related"><h3>Read more</h3><ul><li><a href="/a">Old bridge closed again</a></li><li><a href="/b">Who pays for it?</a></li></ul></aside>
<p>Work is to begin in spring. The mayor said that traffic would not be stopped for more than a weekend.</p><div class="advert">Advertisement: new tyres, half price</div>
<blockquote>"We have waited long enough," said one member, who had voted against it twice.</blockquote><p>Opponents said they would go to court.</p></article></div>
<div class="newsletter-signup"><form><label>Get our morning email</label><input type=email><button>Sign up</button></form></div>
<footer><p>Contact us | Privacy policy | Terms</p><p>© 2019 The River Gazette</p></footer></body></html>""",
        ["Council approves new bridge over the river", "The city council voted on Tuesday evening to build a second bridge, after eleven years of argument about where it should stand.", "Work is to begin in spring. The mayor said that traffic would not be stopped for more than a weekend.", '"We have waited long enough," said one member, who had voted against it twice.', "Opponents said they would go to court."],
    ),
    (
        """<html><head><title>t</title><p>Hello world. The whole article stands here although the head was never closed.</p><p>It goes on for a second paragraph, with nothing around it.</p></html>""",
        ["Hello world. The whole article stands here although the head was never closed.", "It goes on for a second paragraph, with nothing around it."],
    ),
    (
        """<!DOCTYPE html><html lang="de"><head><title>Wie Honig entsteht</title></head><body><div id="cookie-hinweis" class="cookie-banner"><p>Wir verwenden Cookies, um unsere Seite zu verbessern.</p><button>Alle akzeptieren</button></div>
<header><div class="logo">Imkerblatt</div><nav><ul><li><a href="#">Startseite</a></li><li><a href="#">Archiv</a></li><li><a href="#">Kontakt</a></li></ul></nav></header>
<main><h1>Wie Honig entsteht</h1><p>Die Biene sammelt Nektar aus vielen Blüten und trägt ihn in den Stock. Dort wird er von Biene zu Biene weitergegeben.</p><p>Mit jeder Weitergabe verliert der Nektar Wasser, bis er dick genug ist, um zu halten.</p>
<p>Ein Volk braucht im Jahr etwa fünfzig Kilo für sich selbst.</p></main><footer><p>Impressum · Datenschutz</p></footer></body></html>""",
        ["Wie Honig entsteht", "Die Biene sammelt Nektar aus vielen Blüten und trägt ihn in den Stock. Dort wird er von Biene zu Biene weitergegeben.", "Mit jeder Weitergabe verliert der Nektar Wasser, bis er dick genug ist, um zu halten.", "Ein Volk braucht im Jahr etwa fünfzig Kilo für sich selbst."],
    ),
    (
        """<html><body><table width="100%"><tr><td colspan=2 class="header"><font size=5><a href="index.html">Jim's Radio Page</a></font></td></tr><tr><td width=150 class="menu"><a href="a.html">Receivers</a><br><a href="b.html">Antennas</a><br><a href="c.html">Links</a></td>
<td class="content"><h2>Repairing an old receiver</h2><p>Before you switch an old set on, look at the capacitors. Those from before the war have nearly always dried out, and they take the transformer with them when they go.</p><p>Replace them one by one and measure after each.</p></td></tr>
<tr><td colspan=2 class="footer">Last updated 3 May 2002. You are visitor 10293.</td></tr></table></body></html>""",
        ["Repairing an old receiver", "Before you switch an old set on, look at the capacitors. Those from before the war have nearly always dried out, and they take the transformer with them when they go.", "Replace them one by one and measure after each."],
    ),
    (
        """<html lang="fr"><head><title>Le phare</title></head><body><nav class="fil-ariane breadcrumb"><a href="/">Accueil</a> &gt; <a href="/cote">La côte</a></nav><article class="texte"><h1>Le phare de la pointe</h1>
<p>Le phare fut allumé pour la première fois en 1847. Son gardien montait deux cents marches chaque soir, une lampe à la main.</p><figure><img src="phare.jpg"><figcaption>Le phare vu du large, vers 1900.</figcaption></figure>
<p>Depuis trente ans, plus personne n'y habite&nbsp;; la lumière s'allume toute seule.</p></article><section class="commentaires comments"><h2>Commentaires</h2><div class="comment"><p>Merci pour cet article, mon grand-père y travaillait.</p></div></section>
<footer>Mentions légales</footer></body></html>""",
        ["Le phare de la pointe", "Le phare fut allumé pour la première fois en 1847. Son gardien montait deux cents marches chaque soir, une lampe à la main.", "Le phare vu du large, vers 1900.", "Depuis trente ans, plus personne n'y habite ; la lumière s'allume toute seule."],
    ),
    (
        """<!DOCTYPE html><html><head><title>Circles</title></head><body><div class="sidebar"><h4>Chapters</h4><ul><li><a href="1">Lines</a></li><li><a href="2">Circles</a></li></ul></div><div class="main content"><h1>The area of a circle</h1>
<p>Cut the circle into thin slices and lay them side by side. The thinner they are, the more the figure looks like a rectangle.</p><p>One side is the radius, the other half the way around. The area is <math><mi>π</mi><msup><mi>r</mi><mn>2</mn></msup></math> squared units.</p>
<pre>area(r):
  return pi * r * r</pre><p>Archimedes knew this, and proved it without slices.</p></div><div class="pagination"><a href="1">Previous</a> <a href="3">Next</a></div></body></html>""",
        ["The area of a circle", "Cut the circle into thin slices and lay them side by side. The thinner they are, the more the figure looks like a rectangle.", "One side is the radius, the other half the way around. The area is πr2 squared units.", "area(r): return pi * r * r", "Archimedes knew this, and proved it without slices."],
    ),
    (
        """<html><head><title>Re: frost</title></head><body><div class="navbar"><ul><li><a href="/">Board index</a></li><li><a href="/faq">FAQ</a></li><li><a href="/register">Register</a></li></ul></div><div class="entry"><h1>Protecting young trees from frost</h1>
<div class="post-body"><div>Wrap the trunks before the first hard night, not after it. Straw is better than plastic because it lets the bark breathe.</div><div>Water the ground well in the evening. Wet soil holds more warmth than dry soil and gives it back until morning.</div></div></div>
<div class="replies"><h3>Replies</h3><div class="reply"><p>I lost two apricots last year, thanks for this.</p></div><div class="reply"><p>Does fleece work as well?</p></div></div><div id="footer">Powered by a very old board</div></body></html>""",
        ["Protecting young trees from frost", "Wrap the trunks before the first hard night, not after it. Straw is better than plastic because it lets the bark breathe.", "Water the ground well in the evening. Wet soil holds more warmth than dry soil and gives it back until morning."],
    ),
    (
        """<html lang=es><head><title>El molino</title><script type="application/ld+json">{"@type":"Article"}</script></head><body><header class="cabecera site-header"><a class="logo" href="/">La Revista</a><form class="search"><input><button>Buscar</button></form></header>
<section class="story-body"><h1>El último molino del valle</h1><p>Cuando Antonio cerró el molino, nadie pensó que volvería a abrirse. Las piedras llevaban paradas nueve años.</p><p>Su nieta volvió de la ciudad con una idea sencilla: harina de verdad, molida despacio, para los hornos del pueblo.</p>
<div class="social share"><a href="#">Compartir</a> <a href="#">Tuitear</a></div><p>Hoy muele tres días por semana.</p></section><div class="mas-leidas popular"><h3>Lo más leído</h3><ol><li><a href="#">La nieve llega antes</a></li><li><a href="#">Una escuela sin niños</a></li></ol></div>
<footer class="pie">Aviso legal. Todos los derechos reservados.</footer></body></html>""",
        ["El último molino del valle", "Cuando Antonio cerró el molino, nadie pensó que volvería a abrirse. Las piedras llevaban paradas nueve años.", "Su nieta volvió de la ciudad con una idea sencilla: harina de verdad, molida despacio, para los hornos del pueblo.", "Hoy muele tres días por semana."],
    ),
    (
        """<html><body><div role="navigation"><a href="/">Main page</a> <a href="/r">Random article</a></div><div id="content" role="main"><h1>Tawny owl</h1><p>The tawny owl is a stocky owl of woodland, common in much of the old world. It hunts at night, mostly from a perch.</p>
<table class="infobox"><tr><th>Length</th><td>37 to 43 cm</td></tr><tr><th>Weight</th><td>385 to 800 g</td></tr></table><h2>Voice</h2><p>What is written as a single call is really two birds: the female calls and the male answers.</p><dl><dt>Female</dt><dd>A sharp rising note.</dd><dt>Male</dt><dd>A long wavering hoot.</dd></dl></div>
<div id="footer" role="contentinfo"><ul><li>This page was last edited in March.</li><li><a href="/p">Privacy policy</a></li></ul></div></body></html>""",
        ["Tawny owl", "The tawny owl is a stocky owl of woodland, common in much of the old world. It hunts at night, mostly from a perch.", "Length", "37 to 43 cm", "Weight", "385 to 800 g", "Voice", "What is written as a single call is really two birds: the female calls and the male answers.", "Female", "A sharp rising note.", "Male", "A long wavering hoot."],
    ),
    (
        """<!doctype html><title>Notes on tides</title><main><article><h1>Notes on tides</h1><p>There are two high tides a day because the sea bulges on both sides of the earth.</p><p>The second bulge puzzles everybody at first. The earth is pulled away from the far water, and so leaves it behind.</p><footer><p>Filed under: sea, moon</p></footer></article></main><script>x=1</script>""",
        ["Notes on tides", "There are two high tides a day because the sea bulges on both sides of the earth.", "The second bulge puzzles everybody at first. The earth is pulled away from the far water, and so leaves it behind."],
    ),
]
