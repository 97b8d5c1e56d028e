"""Labelled pages for ``maintext``: made-up pages of common layouts, the content of each between ⟦ and ⟧."""

_A = "The river rose in the night and by morning the lower road was under water."
_B = "Nobody could say how long it would take, but the mayor asked for patience."
_C = "Two bridges stayed closed, and the school moved its classes to the town hall."
_D = "A short walk along the dam shows what the storm has left behind."
_E = "Read on."
_LONG = "Buy now and save on all the things you never knew you wanted, today only, with free delivery to every place on the map and a gift for each of your friends. " * 3
_MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
_HEAD = "<!DOCTYPE html><html><head><title>Flood</title><style>p{color:red}</style></head>"

PAGES = [
    f"{_HEAD}<body>{_MENU}<div class='ad'>{_LONG}</div><article>⟦<h1>Flood</h1><p>{_A}</p><p>{_B}</p>⟧</article><footer>&copy; The Paper. All rights reserved.</footer></body></html>",
    f"{_HEAD}<body><header><h1>The Paper</h1><p>News since 1901</p></header>{_MENU}<main><article>⟦<h1>Flood</h1><p>{_A} <a href='/x'>More on the river</a>.</p><p>{_C}</p>⟧</article></main><aside class='sidebar'><h2>Popular</h2><ul><li><a href='/1'>Cake of the week</a></li></ul></aside><footer><p>Imprint</p></footer></body></html>",
    f"{_HEAD}<body><div id='cookie-notice' class='notice banner'><p>This site uses cookies. By going on you agree.</p><button>Accept</button></div><div id='content' class='content'>⟦<h2>Flood</h2><p>{_A}</p><p>{_B}</p><ul><li>{_C}</li><li>{_D}</li></ul>⟧</div><div id='footer' class='footer'>Contact and terms</div></body></html>",
    f"{_HEAD}<body>{_MENU}<article>⟦<h1>Flood</h1><p>{_A}</p>⟧<div class='advert'>{_LONG}</div>⟦<p>{_E}</p>⟧</article><section class='comments' id='comments'><h3>Comments</h3><div class='comment'><p>I saw it too, it was a sight to remember for all of us.</p></div><div class='comment'><p>First!</p></div></section></body></html>",
    f"{_HEAD}<body><main>⟦<h1>Flood</h1><p>{_A}</p><blockquote><p>{_B}</p></blockquote>⟧<aside><p>Related: how dams are built and who pays for them in the end.</p></aside>⟦<p>{_C}</p>⟧</main><section id='comments'><article class='comment'><p>Thanks for this report, it helped me a lot.</p></article><form><label>Your comment</label><textarea>Say something</textarea><button>Send</button></form></section></body></html>",
    f"{_HEAD}<body><div class='header'>The Paper</div><div class='menu nav'><a href='/'>Home</a> <a href='/a'>World</a></div><div class='post entry-content'>⟦<p>{_A}</p><p>{_B} <b>{_E}</b></p><pre>{_D}</pre>⟧</div><div class='sidebar widget'><p>Follow us for more stories like this one.</p></div></body></html>",
    f"{_HEAD}<body><p class='notice'>Please log in to read more than three stories a month.</p><article>⟦<h1>Flood</h1><p>{_A}<p>{_B}<p>{_C}⟧</article><form action='/s'><p>Get our letter each week</p><input name='q'><button>Sign up</button></form></body></html>",
    f"{_HEAD}<body>{_MENU}<div class='ad ads'>{_A}</div><article>⟦<h1>{_D}</h1><p><b>{_A}<br><p>{_B}</p><p>{_C}</p>⟧</article><footer>&copy; site &middot; {_B}</footer></body></html>",
    f"{_HEAD}<body>⟦<p>{_A}</p><p>{_B}</p>⟧<footer>Imprint</footer></body></html>",
    f"⟦<p>{_A}</p><p>{_D}</p>⟧",
    f"⟦{_A}⟧",
    f"<html><body>⟦{_A}<br>{_B}⟧</body></html>",
    f"{_HEAD}<body><div><div>⟦<h1>Flood</h1><div>{_A}</div><div>{_B}</div>⟧</div></div><div role='navigation'><a href='/'>Home</a></div><div role='contentinfo'>Imprint and terms</div></body></html>",
    f"{_HEAD}<body><div role='banner'>The Paper</div><div role='main'>⟦<p>{_A}</p><table><tr><th>Place</th><td>Level</td></tr><tr><td>Bridge</td><td>4 m</td></tr></table><p>{_E}</p>⟧</div><div role='complementary'>Popular stories of the week</div></body></html>",
    f"{_HEAD}<body><article>⟦<h1>Flood</h1><p>{_A}</p>⟧<div class='newsletter signup'><p>Never miss a story: our letter comes each Friday.</p></div>⟦<p>{_B}</p>⟧<div class='share social'><a href='#'>Share</a> <a href='#'>Send</a></div><div class='related'><h3>Related stories</h3><a href='/d'>Dams and how they fail</a></div></article><div class='sponsored promo'>{_LONG}</div></body></html>",
    f"{_HEAD}<body><nav class='breadcrumb'><a href='/'>Home</a> / <a href='/n'>News</a></nav><section>⟦<h2>Flood</h2><p>{_A}</p><h3>After</h3><p>{_C}</p><ol><li>{_D}</li></ol>⟧</section><div class='pagination'><a href='/2'>Next page</a></div></body></html>",
    f"{_HEAD}<body><div class='popup modal' hidden>Join our club for the best offers in town.</div><div class='wrapper'><div class='main'>⟦<p>{_A}</p><dl><dt>Level</dt><dd>{_D}</dd></dl><figure><figcaption>{_E}</figcaption></figure>⟧</div><div class='aside'>Weather and traffic</div></div><div class='copyright'>The Paper, all rights reserved</div></body></html>",
    f"{_HEAD}<body><aside><p>{_D}</p><p>{_A}</p></aside><article>⟦<p>{_E}</p>⟧</article><aside>{_LONG}</aside></body></html>",
    f"{_HEAD}<body><ul class='nav'><li><a href='/'>Home</a></li></ul><div class='article text'>⟦<p>{_A}</p><p><em>{_B}</em> <a href='/x'>{_D}</a> <code>{_E}</code></p>⟧</div><div class='disqus thread'><p>What do you think of it?</p></div><div class='reviews'><p>Five stars</p></div></body></html>",
    f"{_HEAD}<body><div class='alert'>Our shop is closed today.</div><article>⟦<h1>Flood</h1><section><h2>Night</h2><p>{_A}</p></section><section><h2>Day</h2><p>{_B}</p></section>⟧<footer><p>Filed under: weather</p></footer></article><div class='replies'><div class='reply'><p>Well said.</p></div></div></body></html>",
    f"{_HEAD}<body><header><form role='search'><label>Search</label><button>Go</button></form></header><main><div class='banner-ad advertisement'>{_LONG}</div>⟦<h1>Flood</h1><p>{_A}</p>⟧<div class='ad'>{_LONG}</div>⟦<p>{_E}</p>⟧</main></body></html>",
    f"{_HEAD}<body><nav>{_LONG}</nav><header>{_D}</header><article>⟦<p>{_E}</p>⟧</article><footer>{_LONG}</footer></body></html>",
    f"{_HEAD}<body><article>⟦<h1>Flood</h1><p>{_A}</p><ul><li><a href='/1'>{_B}</a></li><li>{_C}</li></ul>⟧</article><div class='cookie consent'>We use cookies to make this site better for you.</div></body></html>",
    f"{_HEAD}<body><nav><p>{_D}</p></nav><div class='ad'><p>{_A}</p></div><form><p>{_B}</p></form><aside><p>{_C}</p></aside><footer><p>{_E}</p></footer></body></html>",
    f"{_HEAD}<body><div><div class='row'><div class='col'>⟦<p>{_A}</p><div>{_B}</div><p>{_C}</p>⟧</div><div class='col'><div class='sidebar'>{_D}</div></div></div></div><div class='footer'>Imprint</div></body></html>",
    f"{_HEAD}<body><div class='page'><div class='header'>The Paper</div><div class='container'><div>⟦{_A}</div><div>{_B} <a href='/x'>{_E}</a></div><div>{_C}⟧</div></div></div></body></html>",
    f"{_HEAD}<body><div id='root'><div>⟦<h2>Flood</h2>{_A}<div>{_C}</div>⟧</div></div></body></html>",
    f"{_HEAD}<body><div class='outer'><div class='inner'><article>⟦<div><p>{_A}</p></div><div><p>{_D}</p></div>⟧</article></div></div><div class='comments'>{_B}</div></body></html>",
    f"{_HEAD}<body><div><div><p>⟦{_A}</p><p>{_B}⟧</p></div></div><div class='banner'>{_C}</div><div class='notice'>{_D}</div><div class='menu'>{_E}</div></body></html>",
    f"{_HEAD}<body><center><div>⟦{_A}<br>{_B}⟧</div><span class='ad'>{_D}</span></center><div class='nav'><a href='/'>Home</a></div></body></html>",
    f"{_HEAD}<body><article>⟦<p><span>{_A}</span></p>⟧<div class='advert advertisement'>{_D}</div>⟦<p>{_C} <span class='x'>{_E}</span></p>⟧<div class='advertising sponsor'>{_B}</div></article></body></html>",
    f"{_HEAD}<body><main><div>⟦<h1>Flood</h1></div><div>{_A}</div><div><div>{_B}</div></div>⟧</main><div class='ads'>{_D}</div></body></html>",
]
