"""Wording of notices that stand in for content, in the languages of the corpus."""

from __future__ import annotations

import re

_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"]*\"|‘[^’]*’")


def unquoted(s: str) -> str:
    """The text without what it quotes: a page may speak of a notice without being one."""
    return _QUOTED.sub(" ", s)


#: A demand to switch on scripts or to pass a check of the browser.
SCRIPT = re.compile(
    r"\b(?:enable|activate|turn(?:ing)? on|switch on|allow) (?:java ?scripts?|scripts|cookies)|(?:java ?scripts?|scripts)(?: and cookies)? (?:is|are|must be|has to be|have to be|switched|turned) (?:required|needed|disabled|off|on|enabled|not)|\b(?:requires?|needs?|without) (?:java ?scripts?|scripts)\b|(?:java ?scripts?|scripts) (?:needed|required|disabled)|has (?:java ?scripts?|scripts) (?:switched|turned) off|while (?:java ?scripts?|scripts) (?:is|are) off"
    r"|checking your browser|(?:one|just a) moment,? (?:we|please)|verify(?:ing)? (?:that )?you are (?:a )?human|are you a robot|loading,? please wait"
    r"|java ?script (?:aktivieren|einschalten|zulassen)|aktivieren sie java ?script|java ?script ist (?:deaktiviert|erforderlich)|benötigt java ?script|java ?script est (?:désactivé|requis|nécessaire)|activ(?:er|ez) java ?script|(?:activar|active|habilit\w+|necesita) (?:el )?java ?script|java ?script (?:está desactivado|desativado|desabilitado|necessário)|(?:ativ\w+|precisa (?:de|ativar)|requer) (?:o )?java ?script|включите java ?script|java ?script (?:отключ|выключ|необходим)\w*|требуется java ?script|для работы сайта",
    re.I,
)

#: An error message or refusal in place of a page.
ERROR = re.compile(
    r"^(?:http )?(?:error|erreur|fehler|ошибка|erro)[ :#]*(?:\d{3}|code)?[.!]?$|^(?:error|erreur|fehler|ошибка|erro) \d+|^\d{3}(?: [-–—:]? ?(?:not found|bad gateway|service unavailable|forbidden|internal server error|gateway time-?out|unauthorized|too many requests|gone))?$|^http error \d|^(?:4\d\d|5\d\d)\b.{0,40}$"
    r"|\b(?:page|url|file|document|resource)\b.{0,40}\b(?:could not|cannot|can’t|can't|was not|not) be? ?found|\b(?:not found|does not exist|no longer (?:exists|available)|has been (?:moved or )?(?:removed|deleted))\b|^(?:oops|whoops|oups|hoppla|ups|упс)\b|something went wrong|try again (?:later|in \w+)|(?:internal|unexpected) (?:server )?error|bad gateway|service (?:is )?(?:temporarily )?unavailable|backend fetch failed|guru (?:reference|meditation)|gateway time-?out|(?:could|can) ?not (?:reach|connect to) (?:its|the) (?:database|server|backend)|database (?:error|connection)|connection (?:refused|timed out)"
    r"|access (?:to .{0,30})?(?:is )?denied|you (?:do not|don’t|don't) have permission|not authori[sz]ed|permission to (?:view|access)|\bforbidden\b|too many requests|slow down and retry|rate limit|session (?:has )?(?:ended|expired|timed out)|request (?:was )?blocked|your (?:ip|address) (?:has been|is) blocked|temporarily (?:down|unavailable)|down for maintenance|under maintenance"
    r"|traceback \(most recent|stack trace|fatal error|uncaught (?:type)?\w*(?:error|exception)|unhandled (?:\w+ )?exception|null ?(?:pointer|reference)|keyerror|typeerror|valueerror|syntaxerror|\bexception (?:at|in)\b|on line \d+|warning: \w+\(\)|\bat \w+(?:\.\w+)+\("
    r"|(?:seite|datei)\b.{0,30}(?:nicht gefunden|gibt es (?:leider )?nicht|existiert nicht|nicht verfügbar)|zugriff verweigert|etwas ist schiefgelaufen|interner (?:server)?fehler|keine berechtigung|versuchen sie es (?:später|erneut)"
    r"|page (?:est )?(?:introuvable|inexistante)|n’existe (?:pas|plus)|n'existe (?:pas|plus)|accès (?:refusé|interdit)|erreur (?:interne|du serveur)|une erreur (?:s’est|s'est|est)|réessayez plus tard"
    r"|(?:página|recurso).{0,40}(?:no existe|no (?:se )?encontr\w+|não (?:está disponível|existe|(?:foi )?encontrad\w+))|página não encontrada|acceso denegado|acesso (?:negado|recusado)|error interno|erro interno|algo (?:salió|correu) mal|int[eé]nt(?:e|elo) (?:de nuevo )?más tarde|tente (?:novamente )?mais tarde"
    r"|страниц\w+ (?:не найден\w*|не существует|удален\w*)|внутренняя ошибка|доступ (?:запрещ|закрыт)\w+|что-то пошло не так|попробуйте позже|не найден[ао]?$",
    re.I,
)

#: A name or site that is parked, for sale, expired, suspended or not set up yet.
PARKED = re.compile(
    r"(?:domain|name|website|site)\b.{0,50}\b(?:for sale|is parked|parked (?:free|by|here|domain)|has expired|expired on|has been suspended|is suspended|was suspended|has been disabled|is disabled|not (?:yet )?(?:been )?(?:set up|configured|published)|registered recently)|\bis for sale\b|\bmay be for sale\b|buy this (?:domain|name)|make an offer|parked (?:free of charge|domain|page|name)|- parked$|^parked\b|sponsored listings|related searches"
    r"|(?:account|site|deployment|website|hosting|page) (?:has been|was|is) (?:suspended|disabled|deactivated|taken offline)|contact your (?:hosting )?provider|^(?:account|site|domain) (?:suspended|disabled|expired|parked|not configured)|if you are the (?:site )?owner|are you the (?:site )?owner"
    r"|(?:new|future) (?:web ?)?site (?:will|is)|coming soon|under construction|will (?:move in|be) here (?:before long|soon)|default (?:web ?)?page|welcome to (?:the default page|your new|nginx|apache)|it works!?$|(?:log in|sign in) to launch|no (?:website|site) (?:is )?(?:configured|here)|there is nothing here yet|future home of|web server is (?:running|working)|launch(?:ing)? soon|site not (?:found|set up)"
    r"|steht zum verkauf|können sie (?:hier )?(?:erwerben|kaufen)|preis anfragen|domain (?:ist )?(?:abgelaufen|geparkt|gesperrt)|konto (?:wurde )?gesperrt|hier entsteht|demnächst|im aufbau"
    r"|(?:domaine|nom|site) .{0,30}(?:à vendre|en vente|expiré|suspendu|en construction|bientôt)|(?:dominio|nombre|sitio) .{0,30}(?:en venta|a la venta|caducad\w+|expirad\w+|suspendid\w+|en construcción|próximamente)|(?:domínio|nome|site) .{0,30}(?:à venda|expirou|expirado|suspenso|em construção|em breve)|ce (?:domaine|nom) est|este (?:dominio|domínio) (?:está|expirou|ha)|(?:домен|имя|сайт)\w* .{0,30}(?:продаётся|продается|продаж|истёк|истек|приостановлен|заблокирован|скоро|в разработке|припаркован)|срок (?:регистрации|действия) .{0,20}ист[её]к|cuenta .{0,20}suspendida|conta .{0,20}suspensa|compte .{0,20}suspendu|аккаунт .{0,20}(?:заблокирован|приостановлен)",
    re.I,
)
