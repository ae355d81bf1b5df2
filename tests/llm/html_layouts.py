"""Layouts that the weights weren't fitted to. `x-main` marks the main text."""

P = "The council met on Monday to talk about the new bridge, and nobody left before the vote was counted."
Q = "Engineers had warned for years that the old one would not carry the traffic of another decade."
R = "Work begins in spring."
LINKS = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>World</a></li><li><a href='/c'>Sport</a></li></ul>"

LAYOUTS = {
    "blog theme": f"""<body class="home single"><div id="page"><header id="masthead" class="site-header"><p class="site-title"><a href="/">My blog</a></p><nav class="main-navigation">{LINKS}</nav></header>
        <div id="primary" class="content-area"><main class="site-main"><article class="post type-post hentry"><x-main><header class="entry-header"><h1 class="entry-title">A bridge at last</h1></header><div class="entry-content"><p>{P}</p><p>{Q}</p><blockquote>{R}</blockquote></div></x-main>
        <footer class="entry-footer">Posted in <a href="/x">News</a></footer></article><div id="comments" class="comments-area"><h2>3 thoughts</h2><ol class="comment-list"><li class="comment"><p>What a fine article this is, thank you all.</p></li></ol><form class="comment-form"><label>Comment</label></form></div></main></div>
        <aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2>{LINKS}</section></aside><footer class="site-footer">Proudly powered by a press</footer></div></body>""",
    "news with adverts inside": f"""<div class="top-bar">Breaking: storm on its way to the coast</div><div class="container"><div class="row"><div class="col-md-8 story"><x-main><h1>A bridge at last</h1></x-main><div class="byline">By A. Writer</div><div class="ad-slot"><p>Buy two pairs of shoes and get the third for nothing, today only.</p></div>
        <x-main><p>{P}</p></x-main><div class="promo-box"><h4>Read also</h4><a href="/r">Ten bridges that fell down in one night</a></div><x-main><p>{Q}</p><p>{R}</p></x-main><div class="newsletter-signup"><p>Sign up for our morning letter and never miss a thing.</p><form><input><button>Go</button></form></div></div><div class="col-md-4 sidebar"><h3>Most read</h3>{LINKS}</div></div></div><div class="footer-links">{LINKS}<p>All rights reserved by the owners of this paper.</p></div>""",
    "old tables": f"""<table width=100%><tr><td colspan=2 id=header><font size=5>Village News</font><tr><td id=menu width=20%><a href=a>Start</a><br><a href=b>Archive</a><br><a href=c>Mail</a><td><x-main><h2>A bridge at last</h2><p>{P}<p>{Q}</x-main></table><div class=copyright>Copyright 1999 by the village</div>""",
    "documentation": f"""<div class="navbar"><a href="/">Tool</a> <a href="/docs">Docs</a></div><div class="toc"><ul><li><a href="#i">Install</a></li><li><a href="#u">Use</a></li></ul></div><div role="main" class="document body"><x-main><h1>Installing</h1><p>{P}</p><pre>make all
make install</pre><h2>Use</h2><p>{Q}</p><ul><li>Run it once.</li><li>Read what it says.</li></ul><table><tr><th>Option</th><td>What it does</td></tr></table></x-main></div><div class="pagination"><a href="/n">Next page</a></div><div role="contentinfo"><p>Built with a generator last Tuesday at noon.</p></div>""",
    "no names at all": f"""<div><a href="/">Home</a> <a href="/b">About</a> <a href="/c">Mail us</a></div><div><x-main><h1>A bridge at last</h1><p>{P}</p><p>{Q}</p><p>{R}</p></x-main></div><footer>Made by hand in our village</footer>""",
    "machine-made names": f"""<div class="css-1x2y3z"><nav class="sc-aXZVg">{LINKS}</nav><main class="css-9q8w7e"><x-main><h1 class="sc-hKMtZM">A bridge at last</h1><p class="sc-eDDNvR">{P}</p><p class="sc-eDDNvR">{Q}</p></x-main></main><aside class="css-33ff"><p>More for you from our partners around the world, chosen daily.</p></aside></div>""",
    "question and answer": f"""<header class="topbar"><form role="search"><input></form></header><nav id="left-sidebar">{LINKS}</nav><div id="mainbar"><div class="question"><x-main><h1>How do I build a bridge?</h1><div class="post-text"><p>{P}</p><p>{R}</p></div></x-main></div><div class="comments"><div class="comment"><p>Have you tried asking an engineer about this?</p></div></div></div><div id="footer"><p>Site design and logo belong to the people who made them.</p></div>""",
    "notice first": f"""<div id="cookie-consent" class="modal"><p>We use cookies so that this page works as you expect it to, and some that pay our bills.</p><button>Accept</button></div><article><x-main><h1>A bridge at last</h1><p>{P}</p><figure><img src="x"><figcaption>The old bridge in its last summer.</figcaption></figure><p>{Q}</p></x-main><div class="share-buttons"><a href="/s">Share</a></div><section class="related"><h3>Related</h3>{LINKS}</section></article>""",
    "broken markup": f"""<html><body><div id=nav><a href=/>Home<a href=/b>About</div><div class=content><x-main><h1>A bridge at last<p>{P}<p><b>{Q}<p>{R}</x-main></div><div class=footer>Small print of the page</body>""",
    "hidden parts": f"""<main><x-main><h1>A bridge at last</h1><p>{P}</p></x-main><p style="display: none">{R} {R} {R}</p><div hidden><p>{Q}</p></div><x-main><p>{Q}</p></x-main><noscript><p>Please turn on scripts to see all of this page.</p></noscript></main><div role="dialog"><p>Subscribe today and save a lot of money.</p></div>""",
}
