"""Labelled exemplars of page furniture and residue, and the index that retrieves them.

Notation: ``#`` stands for a number, ``@`` for the name of the site, ``…`` for any words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass

# One exemplar a line, as publishers word them.
FURNITURE = """
terms of use | privacy | contact | imprint
listen to this article (# min)
the views expressed are those of the author and not of @.
© # @. all rights reserved.
@ is not responsible for linked pages. licence no. #
# comments – join the discussion
reproduction without written consent of @ is prohibited.
story continues below
follow @ on your favourite network
share this story: mail | print | copy link
share post send save for later
by reading on you agree to our use of cookies and similar storage.
your privacy: we and our # partners store data. agree / reject
we use cookies to keep @ running. accept all | settings
this site stores cookies on your device. manage choices
please turn on javascript to see the comments.
get the @ newsletter every morning – sign up
sponsored content
advertisement
we value your privacy. # vendors may store a … cookie.
subscribe for # a month and read the … archive
sign up for the … alert from …
newsletter: … in your inbox from …
you are here: …
jump to: …
reader poll on …
gallery: …
next: …
previous: …
tags: …
topics: …
nachdruck nur mit genehmigung von @.
der newsletter von @: jetzt bestellen
# kommentare – mitreden
anzeige
weiter nach der werbung
wir und unsere # partner speichern daten auf ihrem gerät.
lesezeit # minuten
© # @. alle rechte vorbehalten.
artikel teilen: mail | drucken | link kopieren
impressum | datenschutz | kontakt | agb
diese seite verwendet cookies. alle akzeptieren | einstellungen
für kommentare bitte javascript einschalten.
abo ab # euro: … lesen
sie sind hier: …
schlagworte: …
vorheriger beitrag: …
nächster beitrag: …
bilderstrecke: …
wetter für …: # hinweise
partager : courriel | imprimer | copier le lien
reproduction interdite sans l’accord de @.
# commentaires – réagir
© # @. tous droits réservés.
temps de lecture : # min
la suite après l’annonce
publicité
mentions légales | confidentialité | contact
avec nos # partenaires, nous stockons des données.
ce site utilise des cookies. tout accepter | paramétrer
activez javascript pour lire les commentaires.
recevez la lettre de @ chaque matin
abonnez-vous dès # euros : …
vous êtes ici: …
en images : …
article précédent : …
article suivant : …
mots-clés : …
météo à …: # alertes
reciba el boletín de @ cada mañana
sigue tras el anuncio
publicidad
prohibida la reproducción sin permiso de @.
lectura de # minutos
aviso legal | privacidad | contacto
compartir: correo | imprimir | copiar enlace
usamos cookies propias. aceptar todo | configurar
nosotros y # socios guardamos datos en su equipo.
© # @. todos los derechos reservados.
# comentarios: opine
active javascript para ver los comentarios.
suscríbase por # euros: …
está en: …
etiquetas: …
anterior: …
siguiente: …
galería: …
el tiempo en …: # avisos
receba a carta de @ toda manhã
© # @. todos os direitos reservados.
leitura de # minutos
aviso legal | privacidade | contato
continua após o anúncio
publicidade
reprodução proibida sem licença de @.
partilhar: correio | imprimir | copiar ligação
# comentários: participe
este site usa cookies. aceitar tudo | opções
nós e # parceiros guardamos dados no seu aparelho.
ative o javascript para ver os comentários.
assine por #: …
você está em: …
próxima: …
seguinte: …
galeria: …
tempo em …: # avisos
перепечатка без согласия @ запрещена.
о проекте | контакты | правила
время чтения: # мин
© # @. все права защищены.
рассылка @ каждое утро
сайт использует файлы cookie. принять | настроить
мы и # партнёров храним данные на устройстве.
поделиться: почта | печать | ссылка
# комментариев – обсудить
продолжение после рекламы
реклама
включите javascript, чтобы видеть комментарии.
подписка за #: …
вы здесь: …
фото: …
метки: …
ранее: …
далее: …
погода, …: # сообщений
@对外部链接内容不承担责任
版权所有 © # @ 未经授权不得转载
关于我们 | 联系方式 | 网站地图 | 法律声明
扫一扫,在手机上打开当前页面
备案号:测试备#号
分享到: 微信群 | 邮件 | 复制链接
【打印】【收藏】【纠错】编号#
本文仅代表作者个人观点,与@无关
字号:大 中 小 阅读#次
点击查看全文
我们及#家合作方会在您的设备上存储信息 同意/拒绝
@使用cookie以改进服务。接受 | 设置
请启用javascript以查看评论。
赞助内容
广告
关注@客户端,随时查看更新
继续浏览即表示您同意本站的隐私政策
共#条评论,点击参与
订阅…周报,首月#元
登录后查看…的#条回复
当前位置:…
上一篇:…
下一篇:…
专题:…
标签:…
图集:…
""".strip().split("\n")

# Headings of lists of other stories.
LIST_HEADINGS = "most read|related stories|more on this topic|you may also like|meistgelesen|mehr zum thema|les plus lus|à lire aussi|lo más leído|más noticias|mais lidas|leia também|самое читаемое|читайте также|猜你喜欢|热门排行|更多推荐|相关阅读".split("|")

# Entries of menus.
MENU = (
    "home|money|log in|science|letters|jobs|weather|video|region|world|sport|culture|news|business|tech|technik|wetter|startseite|geld|welt|kultur|anmelden|briefe|accueil|se connecter|vidéo|monde|région|météo|argent|courrier"
    "|dinero|entrar|tiempo|mundo|deporte|portada|cartas|cultura|vídeo|región|região|dinheiro|início|tempo|esporte|мир|культура|погода|войти|регион|спорт|видео|деньги|главная|письма"
    "|视频|体育|招聘|文化|来信|登录|地方|要闻|首页|财经|科技|天气"
).split("|")

# Signatures of a newsroom, which belong to the article.
SIGNATURES = """
by @ staff
reporting by the @ night desk
editing by the @ copy table
von unserem nachtdienst (@)
aus der redaktion von @
la rédaction de @
par le service de nuit de @
por el turno de noche de @
redacción de @
plantão noturno de @
redação de @
дежурная смена @
редакция @
来源:@采编中心
(@夜班编辑部综合整理)
本栏目由@融媒组供稿
""".strip().split("\n")

# Filler, error messages and notices that scripts or a check are required.
RESIDUE = """
@ works best with js turned on. without it there is nothing to show.
noscript: content unavailable without script support
you need to enable javascript to run this app.
please allow scripts from cdn# to view the story.
if nothing happens, turn on scripts and reload.
javascript is disabled in your browser.
please switch it on to use @.
loading...
this content is not available in your country.
this page requires scripts. your browser blocked # of them.
checking your browser before accessing @
this takes up to # seconds. ray #
upgrade your browser to view this page. version # is out of date.
too many requests. retry after # s.
one more step: tick the box to prove you are not a robot (#)
unusual traffic from your network. solve the puzzle to go on.
please wait while we redirect you...
service temporarily unavailable, backend # down for maintenance
sorry, the story you were after has moved or never existed.
warning: include(header.inc): failed to open stream in … on line #
verify you are human by completing the action below.
token #
# – this page is gone for good
your session has expired. please sign in again.
ref #
error #
the requested url … was not found on this server.
database connection failed: access for user 'web'@'node#' timed out
undefined
null
[object object]
something went wrong on our end. we have been told about it.
access denied. reference no. #.#
# bad gateway
internal server error
incident #-#
fatal: out of memory (tried to allocate # bytes)
# not found
# forbidden: …
request … timed out after # ms
gatekeeper/#.#
oops! we can’t find that page.
try the search box or go back to the front page of @.
traceback (most recent call last):
file "app.py", line #, in render
keyerror: 'body'
placeholder paragraph # – do not publish
hello world! first post, number #. edit or delete it.
todo: add body copy (slot #)
write a short description of the story here (max. # characters).
this is a sample post no. #. replace it with your own words.
your text goes here #
body to come. hold # lines.
tk tk tk (# words)
insert text here
text text sample sample text sample text text blah
the quick brown fox jumps over the lazy dog
der gewünschte beitrag … existiert nicht mehr.
ihr zugriff wurde vorübergehend gesperrt. vorgang #
sitzung abgelaufen, bitte neu anmelden
diese seite wurde nicht gefunden (fehler #).
interner serverfehler. vorgang #
bitte bestätigen sie, dass sie kein roboter sind.
bitte aktivieren sie javascript, um @ anzuzeigen.
ohne skripte kann inhalt # nicht geladen werden.
blindtext nr. #, bitte ersetzen
hier steht später der text (# zeichen).
accès refusé (#)
veuillez activer javascript pour afficher ce contenu.
confirmez que vous n’êtes pas un robot
la page demandée n’existe plus. code #
trop de requêtes, réessayez dans # s
scripts bloqués : contenu # indisponible
erreur interne du serveur, dossier #
ceci est un faux-texte n° #, à remplacer
texte à venir (# signes)
no se encuentra la página solicitada (#).
error interno del servidor #
su sesión ha caducado
es necesario activar javascript para continuar.
demasiadas peticiones, espere # s
confirme que no es un robot
sin scripts no se puede mostrar el contenido #
pendiente de redactar (#)
texto de ejemplo n.o #, sustituir
página não encontrada (erro #).
erro interno do servidor #
seu navegador está com o javascript desligado.
ative os scripts para ver o conteúdo #
sua sessão expirou
muitos pedidos, aguarde # s
confirme que você não é um robô
texto de exemplo no #, substituir
aqui entra o texto (#)
страница не найдена. ошибка #
внутренняя ошибка сервера #
слишком много запросов, ждите # с
доступ запрещён, обращение #
скрипты отключены, материал # не загружен
подтвердите, что вы не робот
для просмотра страницы включите javascript.
сессия истекла, войдите снова
здесь будет текст (# знаков)
текст-рыба no #, заменить
# 您要找的内容走丢了
数据库连接失败,请联系管理员(#)
系统繁忙,请稍后再试。错误代码:#-#
请开启浏览器的javascript功能后刷新页面
页面需要脚本支持(模块#被拦截)
登录已超时,请重新登录
您的浏览器不支持脚本,无法显示@的内容
无权访问此页面,请求号#
服务器内部错误 #
该文章已下线
编号#
正在加载......如长时间无反应,请启用js
抱歉,您访问的页面不存在或已被删除(#)
#秒后自动返回首页
请完成安全验证后继续访问
验证编号#
拖动滑块完成拼图 #
您所在的地区无法查看此内容
正在检查您的浏览器,请稍候 #
访问过于频繁,请输入验证码
【这里放导语】【这里放正文】#
此处为示例文字,请在发布前替换。#
正文待补充(稿件#)
稿件占位,勿发 #
""".strip().split("\n")

# Notices and errors as servers, browsers, security services and publishing systems word them.
RESIDUE_GENERAL = """
your browser does not support javascript.
please enable javascript to view this page.
please enable javascript and cookies to continue.
this website requires javascript to be enabled in order to work properly.
javascript must be enabled to use this site.
you have javascript disabled in your browser settings.
to continue, turn on scripts and reload this page.
this site needs cookies; please allow cookies and try again.
your browser is not supported. please update to a newer version.
the page you requested could not be located on our server.
sorry, the page you are looking for does not exist or has been removed.
the page cannot be displayed because an error occurred on the server.
we could not find the content you requested.
this article is no longer available.
page not found
not found. the requested resource could not be found on this server.
you do not have permission to access this resource on this server.
access to this page has been denied.
you have been blocked from this site.
your request was blocked by our security service.
http error #. the upstream server failed to respond in time.
gateway timeout: the server did not receive a timely response.
the server is temporarily unable to service your request due to maintenance downtime or capacity problems.
we are down for maintenance and will be back shortly.
this site is under construction. please come back later.
an unexpected error has occurred. please try again later.
an error occurred while processing your request.
the server encountered an internal error and was unable to complete your request.
error establishing a database connection
your connection timed out. check the address and try again.
your session has timed out. please log in again.
you must be logged in to view this content.
you have exceeded the rate limit. slow down and try again later.
please complete the security check to access this site.
please solve the captcha to prove that you are human.
we need to verify that you are not a robot before you proceed.
our systems have detected unusual traffic from your computer network.
this process is automatic. your browser will redirect to your requested content shortly.
you are being redirected. click here if you are not redirected within # seconds.
please wait while the page is loading.
this content is blocked in your region for legal reasons.
this is the default page of the web server. if you can read this page, it works.
welcome to your new site. this is your first post. edit or delete it, then start writing.
just another website. replace this text with your own content.
the text of this section goes here. add your description.
sample page: this is an example of a page with placeholder text.
image caption goes here. add a title and author name.
this domain is for sale or parked. contact the owner.
index of / parent directory last modified size description
uncaught exception in line # of file. stack trace follows.
notice: undefined variable in template on line #
syntax error: unexpected end of input
null pointer exception at render
ihr browser unterstützt kein javascript.
bitte aktivieren sie javascript in ihrem browser, um diese seite zu sehen.
die angeforderte seite konnte auf dem server nicht gefunden werden.
zugriff verweigert. sie haben keine berechtigung, diese seite zu sehen.
es ist ein fehler aufgetreten. bitte versuchen sie es später erneut.
die seite wird gerade gewartet und ist in kürze wieder da.
bitte warten, die seite wird geladen.
zu viele anfragen. bitte warten sie einen moment.
bitte melden sie sich an, um diesen inhalt zu sehen.
dies ist ein platzhalter. fügen sie hier ihren text ein.
votre navigateur ne prend pas en charge javascript.
veuillez activer javascript dans votre navigateur pour afficher cette page.
la page que vous cherchez est introuvable ou a été supprimée.
vous n’avez pas l’autorisation d’accéder à cette page.
une erreur est survenue sur le serveur. veuillez réessayer plus tard.
le site est en maintenance et sera de retour bientôt.
veuillez patienter pendant le chargement de la page.
votre session a expiré. veuillez vous reconnecter.
insérez votre texte ici. texte provisoire
su navegador no admite javascript.
active javascript en su navegador para ver esta página.
la página que busca no existe o ha sido eliminada.
no tiene permiso para acceder a esta página.
se ha producido un error en el servidor. inténtelo de nuevo más tarde.
el sitio está en mantenimiento y volverá pronto.
espere mientras se carga la página.
escriba aquí su texto. texto provisional
seu navegador não suporta javascript.
ative o javascript no navegador para ver esta página.
a página que você procura não existe ou foi removida.
você não tem permissão para acessar esta página.
ocorreu um erro no servidor. tente novamente mais tarde.
o site está em manutenção e voltará em breve.
aguarde enquanto a página carrega.
insira aqui o seu texto. texto provisório
ваш браузер не поддерживает javascript.
включите javascript в браузере, чтобы открыть эту страницу.
запрошенная страница не существует или была удалена.
у вас нет прав для доступа к этой странице.
на сервере произошла ошибка. повторите попытку позже.
сайт закрыт на обслуживание и скоро вернётся.
подождите, страница загружается.
введите здесь свой текст. временный текст
您的浏览器不支持javascript,请启用后重试。
请在浏览器中启用javascript以查看此页面。
您访问的页面不存在,可能已被删除或移动。
您没有权限访问该页面。
服务器发生错误,请稍后重试。
网站正在维护中,请稍后再来。
页面正在加载,请稍候。
您的会话已过期,请重新登录。
请在此处输入正文内容,此为占位文字。
""".strip().split("\n")

# Furniture as publishers of all kinds word it.
FURNITURE_GENERAL = """
we use cookies and similar technologies to improve your experience.
we use cookies to personalise content and ads, to provide social media features and to analyse our traffic.
by clicking accept you agree to the storing of cookies on your device to enhance site navigation and analyse site usage.
by continuing to use this site you consent to our use of cookies as described in our privacy policy.
you can change your cookie settings or withdraw your consent at any time.
sign in to leave a comment on this story.
log in or create a free account to comment.
subscribe to our newsletter to receive the best stories every week.
sign up for our daily newsletter and never miss a story.
enter your email address to get the latest news in your inbox.
already a subscriber? log in to continue reading.
become a member to support our journalism.
share this article on social media.
follow us on social networks and download our app.
click here to read more related articles.
this material may not be published, broadcast, rewritten or redistributed without permission.
all rights reserved. reproduction in whole or in part is prohibited.
contact us about us careers advertise with us help accessibility sitemap
skip to main content
back to top
report an error in this article
do you have a tip? write to our newsroom.
comments are moderated and may take a while to appear.
wir verwenden cookies, um inhalte und anzeigen zu personalisieren und zugriffe zu analysieren.
mit der weiteren nutzung dieser seite stimmen sie der verwendung von cookies zu.
melden sie sich an, um einen kommentar zu schreiben.
abonnieren sie unseren newsletter und erhalten sie die besten geschichten der woche.
folgen sie uns in den sozialen netzwerken.
nous utilisons des cookies pour personnaliser le contenu et analyser le trafic.
en poursuivant votre navigation, vous acceptez l’utilisation de cookies.
connectez-vous pour laisser un commentaire.
abonnez-vous à notre lettre d’information pour recevoir les meilleurs articles.
suivez-nous sur les réseaux sociaux.
utilizamos cookies para personalizar el contenido y analizar el tráfico.
al continuar navegando, acepta el uso de cookies.
inicie sesión para dejar un comentario.
suscríbase a nuestro boletín para recibir las mejores historias.
síganos en las redes sociales.
usamos cookies para personalizar o conteúdo e analisar o tráfego.
ao continuar a navegar, você aceita o uso de cookies.
faça login para deixar um comentário.
assine a nossa newsletter para receber as melhores histórias.
siga-nos nas redes sociais.
мы используем файлы cookie, чтобы улучшить работу сайта и анализировать трафик.
продолжая пользоваться сайтом, вы соглашаетесь с использованием файлов cookie.
войдите, чтобы оставить комментарий.
подпишитесь на нашу рассылку, чтобы получать лучшие материалы.
подписывайтесь на нас в социальных сетях.
我们使用cookie来改善您的体验并分析流量。
继续使用本网站即表示您同意我们使用cookie。
登录后即可发表评论。
订阅我们的邮件,每周接收精选内容。
关注我们的社交媒体账号。
""".strip().split("\n")

# Text that only fills space. Any of its words fill space, in any number and order.
FILLER = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
text test sample dummy placeholder foo bar baz qux bla blah
asdf jkl qwer qwerty qwertz zxcv hjkl dfgh hjk fghj uiop xxx xx xxxx
tk tktk tbd
""".strip().split("\n")
# Words that fill space in a script without blanks; they are joined to each other in every way.
HAN_FILLER = "某某某|正文内容|此处填写|占位|示例|测试|文字".split("|")
#: Words on the keys of one row, for what hands leave that rest on them.
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю")


#: Pages of a sample that a known word stands on; fewer where the sample is small.
ON_PAGES = 3
#: One of so many pages must hold a known word of a large corpus; so their number is at most that many times the words of a page on average.
ONE_OF_PAGES = 3000
#: Log probability of a pair of letters that a side doesn't have.
RAREST_PAIR = -14.0


class Fill:
    """Log odds, a character, that words are made up of the pieces of filler rather than written: pairs of letters of mock Latin and of rows of keys against those of a corpus."""

    def __init__(self, pages: list[str]):
        """``pages`` are masked texts. Words on several of them are known; what stands on one may itself be filler."""
        on: Counter[str] = Counter()
        for x in pages:
            on.update(set(tokens(x)))
        self._know(on, self.least(len(pages)))

    @staticmethod
    def least(pages: int) -> int:
        """On how many of so many pages a word must stand to be known; beyond a few thousand a fixed share of them."""
        return max(1, min(ON_PAGES, pages // 50), -(-pages // ONE_OF_PAGES))

    @classmethod
    def of_counts(cls, on: dict[str, int], least: int) -> Fill:
        """From the numbers of pages that words stand on."""
        self = cls.__new__(cls)
        self._know(on, least)
        return self

    def _know(self, on: dict[str, int], least: int) -> None:
        pieces = " ".join(w[i:j] for w in FILLER[0].split(" ") for i in range(len(w)) for j in range(i + 2, min(i + 5, len(w)) + 1))
        joined = " ".join(a + b for a, b in zip(pieces.split(" "), reversed(pieces.split(" "))))  # pieces in new words
        keys = " ".join(row[i:j] for row in KEY_ROWS for i in range(len(row)) for j in range(i + 3, len(row) + 1))
        self.tables = [self._pairs([FILLER[0], pieces, joined]), self._pairs([keys])]
        self.known = {w for w, n in on.items() if n >= least}
        self.corpus = self._pairs([f"{w} " * min(on[w], 100) for w in self.known])
        self.letters = {c for w in self.known for c in w}

    @staticmethod
    def _pairs(texts: list[str]) -> dict[str, float]:
        counts: dict[str, float] = defaultdict(float)
        total = 0
        for x in texts:
            for w in _LETTERS.findall(x):
                w = f" {w} "
                total += len(w) - 1
                for i in range(len(w) - 1):
                    counts[w[i : i + 2]] += 1
        return {k: max(math.log(v / total), RAREST_PAIR) for k, v in counts.items()}

    def odds(self, words: list[str]) -> float:
        """The larger of both kinds, over words that the corpus doesn't have; at most 0 if these are fewer than a third. Pairs that neither side has tell nothing."""
        known = self.known
        new = [w for w in words if w not in known]
        if len(new) < 4 or 3 * len(new) < len(words):
            return 0.0
        new = [w for w in new if len(w) > 1]
        letters = "".join(new)
        if len(new) < 4 or sum(c not in self.letters for c in letters) > 0.15 * len(letters):  # few new words, or a script that the corpus doesn't have
            return 0.0
        best, none = -math.inf, RAREST_PAIR
        for table in self.tables:
            total = n = 0.0
            for w in new:
                w = f" {w} "
                for i in range(len(w) - 1):
                    a, b = table.get(w[i : i + 2], none), self.corpus.get(w[i : i + 2], none)
                    total += a - b
                    n += 1
            best = max(best, total / n)
        return best


# A template's slots.
_SLOT = re.compile(
    r"\{\{[^{}\n]*\}\}|\{%[^{}\n]*%\}|[#$]?\{[^\s{}][^{}\n]{0,60}\}|%%[^%\n]+%%|##[^#\n]+##|@[A-Za-z_][\w.|]*@|<%[^%>\n]*%>|</?[A-Za-z_][\w.| ]*>|\[%[^%\]\n]*%\]"
    r"|\[\[(?!IMG_\d+\]\])[^\[\]\n]*\]\]|(?<!\[)\[(?!object [Oo]bject\])[A-Za-z_][\w.| ]*\](?!\])|\$[A-Z_]{3,}\b|__[A-Za-z][\w.|]*?__|【这里[^】]*】"
)
_QUOTED_SLOT = re.compile(r"«(?:[A-Za-z]+[_.|][\w.|]*|[a-z]+_\w+|insert text here|amount|body|caption|city|date|headline|kicker|name|place|quote|section|summary|title|author|lead)»", re.I)
_DIGITS = re.compile(r"\d+")
_WORD, _ASCII_WORD = re.compile(r"[^\W\d_]+|[#@©]|⟨slot⟩"), re.compile(r"[A-Za-z]+|[#@]")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_HAN = re.compile(r"[㐀-鿿]+")


def mask(line: str, site: str | None) -> str:
    """A line in NFKC, case folded, with single blanks, ``⟨slot⟩`` for template slots, ``#`` for numbers and ``@`` for the site's name."""
    s = line if line.isascii() else unicodedata.normalize("NFKC", line)
    if "«" in s:
        s = _QUOTED_SLOT.sub(" ⟨slot⟩ ", s)
    if "{" in s or "[" in s or "#" in s or "%" in s or "@" in s or "<" in s or "$" in s or "【" in s or "__" in s:
        s = _SLOT.sub(" ⟨slot⟩ ", s)
    s = _DIGITS.sub("#", " ".join(s.casefold().split()))
    return s.replace(site, "@") if site else s


def tokens(masked: str) -> list[str]:
    """Words, and pairs of Han characters."""
    if masked.isascii():
        return _ASCII_WORD.findall(masked)
    found = _WORD.findall(masked)
    if not _HAN.search(masked):
        return found
    out: list[str] = []
    for w in found:
        if "㐀" <= w[0] <= "鿿":
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        else:
            out.append(w)
    return out


_LIGHT = {"#", "@"}


@dataclass(frozen=True)
class Exemplar:
    label: str
    text: str
    words: tuple[str, ...]
    open: bool
    first: str
    bag: bool = False


class Index:
    """Inverted index from tokens to exemplars, with TF-IDF containment of a window in its best exemplars.

    ``frequent`` are the inverse document frequencies of a corpus's frequent words, and ``rare`` what all others have; without
    them the exemplars' own are taken. ``bags`` are exemplars of which a window may use any words, as often as it likes.
    """

    def __init__(self, labelled: dict[str, list[str]], floor: float = 0.6, bags: dict[str, list[str]] | None = None, frequent: dict[str, float] | None = None, rare: float | None = None):
        self.floor = floor
        self.exemplars = [
            Exemplar(label, x, tuple(w for w in tokens(mask(x.replace("…", " "), None)) if "…" not in x or len(w) > 1 or not _HAN.match(w)), "…" in x, next(iter(tokens(mask(x.split("…")[0], None))), "")) for label, texts in labelled.items() for x in texts
        ] + [Exemplar(label, x, tuple(tokens(mask(x, None))), False, "", True) for label, texts in (bags or {}).items() for x in texts]
        self.postings: dict[str, list[int]] = defaultdict(list)
        self.inside = [frozenset(e.words) for e in self.exemplars]
        for i, words in enumerate(self.inside):
            for w in words - _LIGHT:
                self.postings[w].append(i)
        n = len(self.exemplars)
        own = {w: math.log(1 + n / len(p)) for w, p in self.postings.items()}
        self.most = rare if frequent is not None and rare is not None else math.log(1 + n)
        self.idf = own if frequent is None else {w: frequent.get(w, self.most) for w in own}
        self.frequent = frequent or {}
        self.weights = {**self.idf, **dict.fromkeys(_LIGHT, 0.5)}
        self.openings = {e.first for e in self.exemplars if e.open}
        self.mass = [sum(self.idf[w] for w in words - _LIGHT) for words in self.inside]

    def weight(self, word: str) -> float:
        return 0.5 if word in _LIGHT else self.idf[word] if word in self.idf else self.frequent.get(word, self.most)

    def best(self, words: list[str]) -> tuple[float, str]:
        """(containment, label) of the exemplars that hold most of the window's weight: the best single one, or the two best of one label
        together. Of an exemplar with open words, its own words must all stand in the window, which must begin like it."""
        if not words:
            return 0.0, ""
        own, rest, most = self.weights, self.frequent, self.most
        hits = [own[w] for w in words if w in own]
        known = sum(hits)
        total = known + (sum([rest.get(w, most) for w in words if w not in own]) if rest else most * (len(words) - len(hits)))
        if known < self.floor * total and words[0] not in self.openings:  # no exemplars can hold enough of the window
            return 0.0, ""
        shared: dict[int, float] = defaultdict(float)
        for w in set(words) - _LIGHT:
            for i in self.postings.get(w, ()):
                shared[i] += own[w]
        found, label = 0.0, ""
        pairs: dict[str, list[tuple[float, float, int]]] = {}
        for i, mass in shared.items():
            e = self.exemplars[i]
            inside = self.inside[i]
            if e.open:
                value = 1.0 if mass >= 0.999 * self.mass[i] and words[0] == e.first else 0.0
            else:
                part = 1.0 if e.bag else min(1.0, 0.4 + mass / self.mass[i])
                if part >= self.floor:
                    pairs.setdefault(e.label, []).append((mass, part, i))
                if part < self.floor or part <= found:
                    continue
                value = sum([self.weight(w) for w in words if w in inside]) / total * part
            if value > found:
                found, label = value, e.label
        for name, each in pairs.items():
            if len(each) > 1 and found < 1.0:
                (_, p, i), (_, q, j) = sorted(each, reverse=True)[:2]
                value = sum([self.weight(w) for w in words if w in self.inside[i] or w in self.inside[j]]) / total * min(p, q)
                if value > found:
                    found, label = value, name
        return found, label


ENDS, CLOSING = frozenset(".!?。！？…"), "\"”“’»）)]"
COUNT = re.compile(r"[^\W\d_]+|[㐀-鿿]")


SENTENCE = re.compile(r"(?<=[.!?…])[\"”’»)]*\s+|(?<=[。！？])[”’»）]*")


def sentences(masked: str) -> list[str]:
    return [x for x in (p.strip() for p in SENTENCE.split(masked)) if x]


def is_prose(line: str) -> bool:
    """A whole sentence: enough words and a mark at its end."""
    if line.rstrip(CLOSING)[-1:] not in ENDS or not line:
        return False
    return line.count(" ") >= 5 or (not line.isascii() and sum(map(len, _HAN.findall(line))) >= 10)
