"""Labelled pages that the extractor is trained on, written for it.

``data-main`` marks the root of a page's main text, ``data-skip`` a part of it
that is none; the markers are taken out before training.
"""

_TEXT = "Plain words of a longer paragraph that goes on for a while and says what the page is about in some detail."
_HEAD = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Site name</title><style>p{margin:0}</style><script>var a=1;</script></head>'
_NAV = '<nav class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'

PAGES = [
    f'{_HEAD}<body>{_NAV}<div class="ad">Buy this now</div><article data-main><h1>Title</h1><p><b>Lead text.<br><p>{_TEXT}</p><p>Short.</p></article><footer>&copy; site &middot; words</footer></body></html>',
    f'{_HEAD}<body><header><a href="/">Logo</a><h1>Site</h1></header>{_NAV}<main data-main><article><h2>Title</h2><p>{_TEXT} <a href="/x">link</a> on.</p><ul><li>First point</li><li>Second point</li></ul></article></main><aside class="sidebar"><h3>More</h3><ul><li><a href="/r">Other story</a></li></ul></aside><footer><p>All rights reserved</p></footer></body></html>',
    f'{_HEAD}<body><div id="header" class="site-header"><span>Brand</span></div><div id="nav" class="navigation navbar"><a href="/1">One</a> <a href="/2">Two</a></div><div id="content" class="content post-content" data-main><h1>Title</h1><p>{_TEXT}</p><blockquote><p>A quote.</p></blockquote><pre>code here</pre><div class="advertisement banner sponsored" data-skip>Great offer</div><p>{_TEXT}</p></div><div id="footer" class="site-footer"><p>Contact us</p></div></body></html>',
    f'{_HEAD}<body><div class="cookie-notice consent"><p>We use cookies to make this better for everyone who reads.</p><button>Accept</button></div><article class="post entry" data-main><header data-skip><span>By the desk</span></header><p>{_TEXT}</p><p>{_TEXT}</p><form class="newsletter subscribe" data-skip><label>Mail</label><input type="text"><button>Send</button></form><p>End.</p><section class="comments" id="comments" data-skip><h3>Comments</h3><div class="comment"><p>I liked this story a lot and will read it again with my friends.</p></div></section></article><footer>Imprint</footer></body></html>',
    f'{_HEAD}<body><main data-main><h1>Title</h1><section><h2>Part</h2><p>{_TEXT}</p><table><tr><th>Name</th><td>Value</td></tr></table></section><section><h2>Other part</h2><p>{_TEXT} <em>stressed</em> <code>x</code></p><dl><dt>Term</dt><dd>Meaning</dd></dl></section><aside data-skip><p>Related reading that is not part of this text at all.</p></aside></main><div class="comments comment-list" id="disqus_thread"><ol><li class="comment"><p>First! This is what a reader thinks of it, in several words.</p></li></ol></div></body></html>',
    f'{_HEAD}<body><div class="wrapper container"><div class="sidebar widget"><p>Popular now and other lists of things to read on this site.</p></div><div class="article main story-body" data-main><p>{_TEXT}</p><figure><img src="x"><figcaption>A picture</figcaption></figure><p>{_TEXT}</p><div class="share social" data-skip><a href="/s">Share</a></div><nav class="breadcrumb pagination" data-skip><a href="/p">Next</a></nav></div></div><div class="related recommended promo"><h4>Also read</h4><p>Another headline with some words</p></div></body></html>',
    f'{_HEAD}<body data-main><p>{_TEXT}</p><p>{_TEXT}</p><p>Last words.</p><nav data-skip><a href="/n">Menu</a></nav><footer data-skip>Foot</footer></body></html>',
    f'<html><body>{_NAV}<div role="main" class="body text" data-main><h1>Title</h1><div><p>{_TEXT}</p></div><div>{_TEXT}</div><div class="notice alert warning popup modal" data-skip><p>Please sign in to read more of our texts every day.</p></div></div><div role="contentinfo"><p>Terms</p></div><noscript>Turn scripts on</noscript></body></html>',
    f'<html><body><div class="masthead top-bar header"><p>Daily words for everyone since long ago</p></div><article data-main><p>{_TEXT}</p><ol><li>One</li><li>Two <b>bold</b></li></ol><h3>Head</h3><p>{_TEXT}</p><div class="ads ad-slot adsbygoogle" data-skip><p>Buy cheap things here today with a discount</p></div><div class="reader-comments responses replies" data-skip><p>Another reader says that it was not so, and gives reasons.</p></div></article><section class="comments"><p>A reader answers at some length to what was said before.</p></section><form><p>Search this site for words</p><input></form><div class="copyright legal"><p>Copyright words</p></div></body></html>',
    f'<html><body><div class="menu"><ul><li>Plain entry</li><li>Other entry</li></ul></div><div class="announcement notification message"><p>The site will be down tonight for some hours of work.</p></div><article data-main>{_TEXT}<br>{_TEXT}<span>more</span></article><footer><div><p>{_TEXT}</p></div></footer></body></html>',
    f'<html><body><article data-main><h1>Title</h1><p>{_TEXT}</p><p>{_TEXT}</p></article></body></html>',
    f"<!--main-->{_TEXT} {_TEXT}",
    f"<!--main--><p>{_TEXT}</p><p>{_TEXT}</p>",
    f'<html><body><article data-main><h1>Title of it</h1><p><b>{_TEXT}<br><p>No.</p><p>{_TEXT}</p><p><b>Yes.<br></article><footer>Words</footer>',
    f"<html><body>{_NAV}<article data-main><div><div><p>{_TEXT}</p></div><div><h2>Part</h2><div>{_TEXT}</div></div></div><div><div><div><p>Few.</p></div></div></div></article><footer><div>Words</div></footer></body></html>",
    f'<html><body><div><div>{_NAV}</div></div><div><div class="content" data-main><div><div><p>{_TEXT}</p><ul><li>One</li></ul></div></div><div class="row"><div class="column"><p>{_TEXT}</p></div></div><div><h3>More</h3><p>{_TEXT}</p></div></div></div></body></html>',
    f"<html><body><article data-main><header data-skip><p>Site words</p></header><p>{_TEXT}</p><form data-skip><p>Join us</p><input></form><p>Mid.</p><form data-skip>Mail<button>Go</button></form><aside data-skip><p>Beside it</p></aside><nav data-skip><a href='/n'>Next</a></nav><p>{_TEXT}</p><footer data-skip><p>By us</p></footer></article><form><label>Find</label></form><aside>More</aside></body></html>",
]
