"""Hand-written pages. Every block of the article begins with §; the rest is not article. Names are of many kinds, or none."""

LAYOUTS = {
    "plain page of unknown names": """<div class='hd'><a href='/'>My site</a></div><div class='c1'><h1>§Rain over the hills</h1><p>§The first paragraph tells what happened on that long day in spring.</p><p>§The second one goes on for a while and ends with a full stop.</p></div><div>Copyright 2024 My site</div>""",
    "aside inside an article, list and pre after it": """<main><article><h1>§How to build it</h1><p>§Begin with the parts that you have at hand and put them together.</p><aside class='related'><h4>Related articles</h4><ul><li><a href=/a>Another way</a></li><li><a href=/b>More of it</a></li></ul></aside><ul><li>§Take the first part.</li><li>§Turn it round.</li></ul><pre>§make all
    make install</pre></article></main>""",
    "main in a wrapper": """<div id="page"><header><a href="/">Home</a> <a href="/n">News</a></header><main><h1>§A quiet town</h1><p>§People came from far away to see the market in the old square.</p><p>§They stayed for a week and left with heavy bags.</p></main><footer>All rights reserved</footer></div>""",
    "article only": """<article><h1>§Only this</h1><p>§There is nothing else on this page but a few lines of text.</p></article>""",
    "no wrapper at all": """<html><body><h1>§Notes from the field</h1><p>§We walked along the river until the sun went down behind the trees.</p><p>§Nobody spoke for a long time, and the birds fell silent too.</p></body></html>""",
    "usual blog": """<nav class="navbar"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav><div class="post"><h2>§Bread at home</h2><div class="entry-content"><p>§Mix flour and water, then wait until it has doubled in size.</p><p>§Bake it for forty minutes in a very hot oven.</p></div></div><div id="sidebar"><h3>Popular</h3><a href="/x">Soup</a></div><footer>Powered by love</footer>""",
    "comments below": """<article><h1>§On winning</h1><p>§It is not the main thing, but it helps a great deal in the end.</p></article><section id="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>I do not agree with a single word of this piece.</p></div><div class="comment"><b>Bob</b><p>Well said, I will show it to my friends.</p></div></section>""",
    "comments inside the article": """<article class="story"><h1>§The bridge</h1><p>§It was closed on Monday after a storm had torn off a railing.</p><p>§Repairs will take a month at least, the mayor said.</p><div class="comments"><h4>2 comments</h4><div class="comment">About time that somebody looked at it.</div><div class="comment">I cross it every day.</div></div></article>""",
    "cookie banner first": """<div class="cookie-banner"><p>We use cookies to make this site better for you.</p><button>Accept</button></div><main><h1>§Frost in May</h1><p>§Farmers covered their trees at night and hoped for the best.</p></main>""",
    "adverts between paragraphs": """<div class="article"><p>§The ship left the harbour before dawn with forty men on board.</p><div class="ad">Buy two, get one free today only.</div><p>§By noon it had passed the lighthouse and turned to the north.</p><div class="ad-slot"><a href="/buy">Sale</a></div><p>§No one saw it again until the following autumn.</p></div>""",
    "search form and newsletter": """<form class="search"><input name=q><button>Search</button></form><article><h1>§Night trains</h1><p>§They are back on the rails after twenty years in the sheds.</p></article><div class="newsletter"><p>Subscribe to our newsletter</p><input name=m><button>Subscribe</button></div>""",
    "table in the article": """<nav><a href="/">Home</a></nav><article><h1>§Prices this week</h1><p>§Here is what the main goods cost at the market on Friday.</p><table><tr><th>§Goods</th><th>§Price</th></tr><tr><td>§Apples</td><td>§Two a kilo</td></tr><tr><td>§Pears</td><td>§Three a kilo</td></tr></table><p>§Prices may change at any time without a word.</p></article>""",
    "definition list": """<main><h1>§Words of the sea</h1><dl><dt>§Bow</dt><dd>§The front end of a ship, where the anchor hangs.</dd><dt>§Stern</dt><dd>§The back end, where the rudder is.</dd></dl></main><footer><a href="/legal">Imprint</a></footer>""",
    "table layout of old": """<table><tr><td><a href=1>Home</a><br><a href=2>Links</a><br><a href=3>Contact</a></td><td class="body"><h1>§My holidays</h1><p>§We went to the mountains and it rained for nine days without a break.</p><p>§On the tenth day we went home.</p></td></tr></table>""",
    "headings and lists": """<article><h1>§Packing list</h1><h2>§Clothes</h2><ul><li>§Two warm shirts</li><li>§A coat that keeps out the rain</li></ul><h2>§Food</h2><ol><li>§Bread</li><li>§Cheese that does not melt</li></ol></article><aside><h3>Tags</h3><a href=/t1>travel</a> <a href=/t2>lists</a></aside>""",
    "byline and date": """<article><h1>§Vote put off</h1><p class="byline">§By Jane Roe</p><p>§The council will meet again in June to talk about the budget.</p><p>§Three members were absent on Tuesday.</p></article><footer>Copyright</footer>""",
    "quote": """<main><p>§She stood up and said what all had been thinking for weeks.</p><blockquote><p>§We cannot go on like this.</p></blockquote><p>§Then she left the room and shut the door behind her.</p></main>""",
    "figure with caption": """<div class="post-body"><p>§The tower is older than the town around it by two hundred years.</p><figure><img src=t.jpg><figcaption>§The tower from the south side.</figcaption></figure><p>§It was restored after the war.</p></div><div class="share"><a href=#>Share</a></div>""",
    "references decoded": """<article><h1>§Fish &amp; chips</h1><p>§It costs &lt; 5 &euro; and comes wrapped in&nbsp;paper.</p></article><nav><a href="/">Menu</a></nav>""",
    "unknown names, side links": """<div class="x7"><div class="k2"><a href="/1">Home</a> <a href="/2">Archive</a> <a href="/3">Contact</a></div><div class="m4"><h1>§An old mill</h1><p>§The wheel had not turned since the great flood of that year.</p><p>§A family from the city bought it and made it a house.</p></div><div class="r9"><h3>Related articles</h3><a href="/4">New roof</a> <a href="/5">Old barns</a></div></div>""",
    "css module names": """<div class="css-1a2b3c"><header><a href="/">Home</a></header><div class="css-99ffee"><h1>§Snow on the line</h1><p>§Trains stood still for half a day while crews cleared the track.</p><p>§Passengers were given tea and blankets.</p><p>§Service returned to normal in the evening.</p></div><footer><a href="/p">Privacy policy</a></footer></div>""",
    "role attributes": """<div role="navigation"><a href="/">Home</a></div><div role="main"><h1>§Clear water</h1><p>§The lake can be swum in again after ten years of work.</p></div><div role="complementary"><p>Read more</p><a href="/z">Rivers</a></div><div role="contentinfo">All rights reserved</div>""",
    "item properties": """<div itemprop="articleBody"><p>§Nothing moved in the street but a dog looking for shade.</p><p>§At four the shops opened again.</p></div><div class="tags"><a href=/h>heat</a></div>""",
    "breadcrumbs and pager": """<ol class="breadcrumb"><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ol><article><h1>§New school opens</h1><p>§Four hundred children walked through the doors for the first time.</p></article><div class="pager"><a href=/p>Previous</a> <a href=/q>Next</a></div>""",
    "open paragraphs": """<article><h1>§Loose ends</h1><p>§The first paragraph is never closed by its author<p>§neither is the second, which goes on and on.<p>§And the third ends the page.</article><footer>Contact us</footer>""",
    "scripts and styles": """<style>.a{color:red}</style><script>var a = "<p>no</p>";</script><article><h1>§After the match</h1><p>§Both teams shook hands and walked off the pitch.</p><script>track(1)</script><p>§The score was two all.</p></article>""",
    "code and prose": """<main><h1>§Sorting</h1><p>§Call the function on a list and it gives back a new one.</p><pre><code>§xs = sorted(ys)</code></pre><p>§The old list stays as it was before.</p></main><aside><a href="/doc">Docs</a></aside>""",
    "nested sections": """<article><header><h1>§A short history</h1></header><section><h2>§Early days</h2><p>§Nobody knows who laid the first stone of the wall.</p></section><section><h2>§Later days</h2><p>§It was pulled down to make room for a road.</p></section></article><footer>Powered by x</footer>""",
    "author box at the end": """<div class="article-body"><p>§The orchestra played for two hours without a pause.</p><p>§The hall was full to the last seat.</p></div><div class="author-box"><h4>About the author</h4><p>Writes about music since the nineties.</p></div>""",
    "dialog and alert": """<dialog>Sign in to continue reading</dialog><div class="alert">Update your browser</div><article><h1>§Bees in town</h1><p>§Roofs have become the best place to keep a hive in summer.</p></article>""",
    "aside in the middle, prose around": """<article><p>§Prices rose again in March, more than anyone had thought.</p><aside><h4>Read more</h4><a href="/a">What it means for you</a></aside><p>§Bread alone went up by a tenth within a single month.</p><table><tr><td>§March</td><td>§ten in a hundred</td></tr></table></article>""",
    "divs instead of paragraphs": """<nav><a href="/">Home</a></nav><div class="story"><div>§The mountain hut is open from June to the end of September.</div><div>§Beds must be booked by telephone a week ahead.</div></div><footer>Imprint</footer>""",
    "long list article": """<main><h1>§Ten rules</h1><ol><li>§Do not run in the halls.</li><li>§Close the windows at night.</li><li>§Keep the kitchen clean at all times.</li><li>§Feed the cat.</li></ol></main><div class="popular"><h3>Trending</h3><ul><li><a href=/1>Eleven rules</a></li><li><a href=/2>Nine rules</a></li></ul></div>""",
    "empty article": """<nav><a href="/">Home</a><a href="/a">About</a></nav><footer>Copyright 2020</footer>""",
}
