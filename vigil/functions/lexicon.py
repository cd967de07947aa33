"""Rule tables and word lists of the incident domain, as data for vigil.functions.rules.

Everything in this module is a fixed value: results must equal those of the tables that users have today.
"""

from __future__ import annotations

from vigil.functions.rules import Rule as R

# Symptoms, with the technical concepts they stand for and the kind of failure.
SYMPTOMS = [
    R(r"\b(slow(?:er|ly|ness)?|sluggish|takes? (?:forever|ages|minutes|very long)|lag(?:gy|s)?\b|crawl\w*|response times?|latency|degrad\w*|performance)",
      "slow response", "performance degradation", ("performance degradation", "high latency", "slow response time")),
    R(r"\b(freez\w*|froze|hangs?\b|hanging|hung\b|unresponsive|not responding|stop(?:s|ped)? responding|locks? up|becomes? stuck)",
      "freeze / hang", "performance degradation", ("application freeze", "unresponsive", "hang")),
    R(r"\b(time[sd]? ?out|timing out|timeouts?)\b", "timeout", "intermittent failure", ("timeout", "request timeout", "connection exhaustion")),
    R(r"((?:can(?:no|')?t|unable to|not able to|nobody can) (?:log ?in|sign ?in|login)|login (?:loop|fail\w*)|access denied|authentication fail\w*|\bsso\b|back to the login|saml|kerberos)",
      "login failure", "hard failure", ("authentication failure", "single sign-on", "login")),
    R(r"(account\w* (?:gets |is |keeps getting )?locked|locked out|lockouts?)", "account lockout", "intermittent failure", ("account lockout", "stale credentials")),
    R(r"(unauthori[sz]ed|brute.force|intrusion|multiple failed login|suspicious login)", "unauthorized access attempt", "security event",
      ("unauthorized access", "brute force", "security incident")),
    R(r"(error (?:page|message|screen)|generic error|exception|runtime error|short dump|\bdump\b|abend|crash\w*|nullpointer)", "application error / crash", "hard failure",
      ("application error", "exception", "crash")),
    R(r"((?:does ?n.?t|do not|not|won.?t) (?:start|boot)|black screen|blue screen|bitlocker|smart failure)", "does not start / boot", "hard failure",
      ("start-up failure", "boot failure", "disk failure")),
    R(r"(not enough (?:disk )?space|disk (?:is )?full|no (?:free )?space|out of space|capacity alert|storage (?:threshold|exceeded)|\b(?:99|100)% (?:used|full)|quota|threshold exceeded)",
      "storage full", "resource exhaustion", ("storage capacity", "disk full", "free space")),
    R(r"(\bcpu\b|processor|excessive cpu|tight loop)", "high CPU", "resource exhaustion", ("high CPU", "runaway process", "resource exhaustion")),
    R(r"(\bheap\b|out of memory|memory (?:usage|leak|pressure|climbs)|garbage.collection|\bgc pauses?)", "memory pressure", "resource exhaustion",
      ("memory leak", "heap exhaustion", "garbage collection")),
    R(r"(yesterday.?s (?:figures|data)|no data|reports? .*empty|empty report|data was not loaded|not (?:been )?(?:loaded|updated)|overnight update|job (?:chain )?(?:failed|aborted|ended)|return code|interface (?:file|error)|batch job|import job)",
      "missing or stale data", "hard failure", ("batch job failure", "interface file", "data load")),
    R(r"((?:wrong|incorrect|duplicate|corrupt\w*) (?:data|records?|address\w*|contracts?|details|values?|figures)|referential integrity|data.quality)", "incorrect data", "data integrity",
      ("data quality", "data corruption", "import error")),
    R(r"(\bvpn\b|tunnel|remote access|working from home|remote colleagues)", "VPN disconnects", "intermittent failure", ("VPN", "tunnel renegotiation", "remote access")),
    R(r"(packet loss|network (?:drops|keeps dropping|is down)|keeps dropping|disconnect\w*|connectivity|interface errors|crc errors|collisions)", "network connectivity loss",
      "intermittent failure", ("packet loss", "network connectivity", "link errors")),
    R(r"(\bprint\w*|spool\w*)", "printing fails", "hard failure", ("print queue", "printer", "spooler")),
    R(r"(certificate|\bssl\b|\btls\b|handshake|not private|pkix)", "certificate / TLS error", "hard failure", ("certificate expiry", "TLS handshake", "PKI")),
    R(r"(cannot send|outbox|outlook|mailbox|e-?mails?\b)", "mail problem", "hard failure", ("mailbox", "Outlook", "Exchange")),
    R(r"(citrix|virtual desktop|published (?:desktop|app\w*)|virtual workplace|session (?:hangs|frozen|will not))", "virtual session problem", "intermittent failure",
      ("Citrix", "VDI session", "user profile")),
    R(r"(card reader|cash device|cash dispenser|self-service terminal|out of service)", "banking device fault", "hard failure", ("card reader", "banking device", "device firmware")),
    R(r"(security software|quarantin\w*|blocked by|false positive|antivirus|endpoint (?:agent|protection))", "blocked by endpoint security", "hard failure",
      ("endpoint protection", "quarantine", "security policy")),
    R(r"(stream(?:ing)?\b|broadcast|video)", "stream failure", "hard failure", ("streaming", "media delivery")),
    R(r"(encod\w*|codec|media conversion)", "encoder failure", "hard failure", ("encoder", "codec", "media conversion")),
    R(r"(cache miss|\bcdn\b|media loading)", "slow media delivery", "performance degradation", ("CDN cache", "cache miss")),
    R(r"(i/o latency|paths? (?:are |is )?down|multipath|fibre.channel|storage path)", "storage I/O latency", "performance degradation", ("SAN path", "I/O latency", "multipath")),
    R(r"(unable to extend|tablespace|transaction log (?:is )?(?:\d+% )?full|ora-\d+)", "database space exhausted", "resource exhaustion", ("tablespace full", "transaction log full")),
    R(r"(full (?:table )?scan|execution plan|optimi[sz]er|slow quer\w*|query time|queries (?:are )?(?:slow|timing))", "slow queries", "performance degradation",
      ("slow query", "missing index", "execution plan")),
    R(r"(not available|unavailable|\bdown\b|outage|not reachable|cannot connect|service stopped)", "service unavailable", "hard failure", ("service unavailable", "outage")),
    R(r"(button does nothing|does ?n.?t work|not working|stopped working|broken|cannot (?:find|finish|save|approve)|fails? (?:intermittently|at step))", "function not working",
      "functional failure", ("functional defect",)),
    R(r"(rounded|rounding|locked after|by design|seems to be a bug|different(?:ly)? than)", "unexpected behaviour", "no technical fault", ("expected behaviour", "functional design")),
]

# Components.
COMPONENTS = [
    R(r"(database|\bsql\b|quer(?:y|ies)|tablespace|oracle|\bdb\b|\bdba\b|ora-\d+|awr)", "Database"),
    R(r"(\bsso\b|authentication|log ?in|adfs|active directory|\bad\b sync|kerberos|saml|identity provider|account (?:gets |is )?locked|locked out)", "Authentication service"),
    R(r"(\bvpn\b|tunnel|ipsec|\bike\b)", "VPN gateway"),
    R(r"(\bswitch\b|router|packet loss|network|\bport\b|duplex|crc)", "Network"),
    R(r"(\bsan\b|\blun\b|volume|storage|disk space|file ?system|shared drive|\bhba\b|multipath)", "Storage"),
    R(r"(laptop|desktop pc|workstation|bitlocker|\bbios\b)", "End-user device"),
    R(r"(printer|print (?:queue|job|server)|spooler)", "Printer"),
    R(r"(card reader|cash device|self-service terminal|banking device)", "Banking device"),
    R(r"(citrix|\bvdi\b|virtual desktop|published desktop|worker server|virtual workplace)", "Citrix / VDI"),
    R(r"(outlook|exchange|mailbox|e-?mail)", "Mail (Exchange/Outlook)"),
    R(r"(\bsap\b|abap|st22|transaction code|sap transport)", "SAP"),
    R(r"(certificate|\btls\b|\bssl\b|pkix|trust ?store)", "TLS certificate"),
    R(r"(security software|endpoint|antivirus|quarantin)", "Endpoint security"),
    R(r"(batch|job chain|scheduler|interface file|import job|nightly)", "Batch / interface"),
    R(r"(\bcpu\b|server|reboot|patch)", "Server"),
    R(r"(encoder|codec|stream|\bcdn\b|media|broadcast)", "Media platform"),
    R(r"(application|\bapp\b|portal|system|screen|dashboard)", "Application"),
]

# Components of configuration-item groups.
GROUP_COMPONENT = {
    "app_server": "Application", "app_web": "Application", "app_desktop": "Application", "sap": "SAP", "citrix_vdi": "Citrix / VDI", "collab": "Mail (Exchange/Outlook)",
    "enduser_hw": "End-user device", "banking_device": "Banking device", "storage": "Storage", "database": "Database", "server": "Server", "network": "Network",
    "security_sw": "Endpoint security", "media": "Media platform",
}

# Root causes.
ROOT_CAUSES = [
    R(r"(memory leak|heap (?:was )?(?:almost )?exhaust\w*|heap usage|session cache|heap dump|\bgc\b|jvm)", "memory leak / heap exhaustion"),
    R(r"(connection pool|pool (?:was )?exhausted|connection leak|stuck connections|close its db connection|connection close)", "connection pool exhaustion"),
    R(r"(defect .{0,40}(?:release|build|version|deploy)|(?:release|build|version) .{0,25}(?:defect|bug)|regression|rolled? .{0,20}back .{0,30}release|release (?:was )?rolled back|hotfix|feature (?:toggle|flag))",
      "release defect (regression)"),
    R(r"((?:token.)?signing certificate|federation|\bidp\b|directory sync|group membership|\bad\b sync|forced ad sync|stale sessions|session store)", "SSO / directory sync failure"),
    R(r"(interface file|input file|file (?:not found|arrived late|was delivered)|malformed|invalid date format|upstream|redeliver\w*|file-watcher|cut-off)", "missing or malformed interface file"),
    R(r"((?:bulk )?import (?:had )?(?:overwrote|mapping|corrupted)|wrong column|faulty import|correction script|data owner|reprocessed the feed)", "faulty data import"),
    R(r"(wrong (?:period|filter|parameters|run date)|incorrect use|user error|operator (?:started|step)|skipped|explained (?:the|this)|work instruction|walked the user)", "user / operator error"),
    R(r"(by design|functional design|intended|works as designed|according to design|not a fault)", "works as designed (no fault)"),
    R(r"(transport|short dump|abap|sap note|support package|program buffer|user buffer)", "SAP transport / program error"),
    R(r"(profile (?:was )?corrupt\w*|roaming profile|citrix profile|worker .{0,20}overloaded|load index|stuck session|drained)", "corrupt user profile / overloaded worker"),
    R(r"(quota|online archive|\bost\b|outlook profile|outlook cache)", "mailbox quota / corrupt OST"),
    R(r"(\bssd\b|disk (?:failed|defect)|smart failure|disk defect|bitlocker|recovery key|loan laptop)", "hardware failure (disk / device)"),
    R(r"(spooler|corrupted job|printer driver|certified driver|fuser)", "print spooler / driver fault"),
    R(r"(card reader|firmware|power-cycl\w*|terminal hung)", "device hardware / firmware fault"),
    R(r"(volume .{0,30}(?:99|100)%|extended the lun|added capacity|log files? (?:filled|grew)|debug logging|log rotation|archived logs|space recovered|storage exceeded|archive old media|expand storage)",
      "storage capacity exhausted"),
    R(r"(crc errors|\bsfp\b|\bhba\b|host bus adapter|fibre cable|multipath|paths? (?:were )?(?:marked )?(?:down|failed))", "SAN path failure"),
    R(r"(full table scan|missing (?:composite )?index|created an index|add(?:ed)? (?:missing )?index\w*|statistics|execution plan|blocking session|held locks|optimi[sz]e query)",
      "inefficient query plan / missing index"),
    R(r"(tablespace|datafile|transaction log|log backup)", "tablespace / transaction log full"),
    R(r"(loop\w*|runaway|98% cpu|antivirus scan|scan started|agent version|excessive cpu|consuming excessive)", "runaway process"),
    R(r"(patch (?:installation|kb|update)|failing patch|after the (?:patch )?reboot|started before its database|delayed start|services? (?:did not start|started by hand)|start-up order)",
      "failed patch / service start-up order"),
    R(r"(\bike\b|ipsec|proposal|security associations|\bmss\b|\bmtu\b|fragmentation|phase 2)", "VPN negotiation / MTU issue"),
    R(r"(duplex|collisions|port \d+|patch cable|backplane|spare port)", "faulty switch port / duplex mismatch"),
    R(r"(certificate (?:on .{0,20})?expired|expired at midnight|pkix|intermediate ca|trust ?store|renewed certificate)", "expired certificate / trust store"),
    R(r"(lockout source|old password|stale credential|mapped drive|previous password)", "stale stored credentials"),
    R(r"(false positive|quarantin\w*|exclusion|security policy|policy rollback|new policy)", "endpoint security false positive"),
    R(r"(cache miss|\bcdn\b)", "CDN cache miss"),
    R(r"(encoder crashed|codec)", "encoder / codec failure"),
    R(r"(failed login attempts|block ip|brute.force|multi-factor)", "brute-force login attempts"),
    R(r"(stream stopped|network interface|streaming service)", "streaming service / network interface failure"),
]

# Triggers, environments, scopes and dependencies.
TRIGGERS = [
    R(r"(after (?:the |last night.s |the weekend )?(?:release|deployment|update|new version|upgrade)|since the new version|new version was (?:deployed|installed)|since the (?:latest )?deployment|weekend release)",
      "deployment / release"),
    R(r"(after (?:the )?(?:monthly )?(?:patch\w*|reboot|maintenance)|patch weekend|since the maintenance window|after .{0,20}maintenance)", "patching / maintenance"),
    R(r"(config(?:uration)? change|after the change|firewall change|policy update|policy change|changed its|after the transport|support package)", "configuration change"),
    R(r"(peak|busy|month.end|start of the month|mornings?\b|high usage|under load|traffic increased)", "load / traffic peak"),
    R(r"(password change)", "password change"),
    R(r"(bulk import|large data load|after a data load|after the data load)", "data load"),
    R(r"(certificate rollover|expired at midnight|at midnight)", "certificate expiry"),
    R(r"(firmware update|bios update|driver update|agent update|client update)", "firmware / driver update"),
    R(r"(nightly run|overnight|during the night|cut-off)", "scheduled batch window"),
]
ENVIRONMENTS = [
    R(r"\b(production|prod|live environment)\b", "Production"),
    R(r"\b(acceptance|staging|uat|test environment|pre-?prod)\b", "Staging"),
    R(r"\b(development|dev environment|\bdev\b)\b", "Development"),
]
SCOPES = [
    R(r"(all users|everyone|nobody can|organi[sz]ation|organi[sz]ation.wide|all branches|whole company)", "organization-wide"),
    R(r"(several departments|multiple departments|department)", "department"),
    R(r"(whole team|our team|the team|one team|several devices|more than one device)", "team"),
    R(r"(some colleagues|a few colleagues|several users|multiple users|few users|colleagues|many users|small group)", "multiple users"),
    R(r"(only me|only i\b|single user|just me|one user|only my|i seem to be the only)", "single user"),
]
DEPENDENCIES = [
    R(r"(oracle|sql server|database|\bdb\b)", "database"),
    R(r"(active directory|adfs|\bidp\b|identity provider|\bad\b sync|directory)", "identity provider / Active Directory"),
    R(r"(upstream|interface file|sending team|supplier (?:redelivered|system))", "upstream system"),
    R(r"(\bsan\b|fibre|\blun\b)", "SAN storage"),
    R(r"(\bcdn\b)", "CDN"),
    R(r"(firewall|\bpeer\b)", "network peer / firewall"),
    R(r"(\bpki\b|\bca\b|certificate authority)", "PKI"),
    R(r"(scheduler|job chain)", "job scheduler"),
    R(r"(connection pool)", "database connection pool"),
    R(r"(profile store|roaming profile)", "user profile store"),
]

# Names of services, and words that don't tell one from another.
SERVICE = r"\b((?:[a-z][\w-]*\s){0,3}(?:portal|application|system|service|dashboard|app|banking|mailbox|desktop|workplace|terminal))\b"
SERVICE_STOP = ("the", "our", "a", "an", "this", "that", "my", "application", "system", "service", "app")

# What closure classes say of cause and failure, effects of failures, and phrases of scopes.
CLASS_ROOT_CAUSE = {
    "hardware_fix": "hardware fault (per closure code)", "software_fix": "software fault (per closure code)", "data_fix": "data error (per closure code)",
    "user_or_operator": "user / operator error", "no_fault_found": "works as designed (no fault)",
}
CLASS_FAILURE = {"no_fault_found": "no technical fault", "user_or_operator": "no technical fault"}
EFFECT = {
    "performance degradation": "degraded performance", "hard failure": "service unavailable", "intermittent failure": "intermittent service disruption",
    "resource exhaustion": "service disruption from exhausted resources", "functional failure": "business function not working", "data integrity": "incorrect business data",
    "security event": "security exposure", "no technical fault": "no service disruption (user expectation)",
}
SCOPE_PHRASE = {
    "organization-wide": "across the organization", "department": "for a department", "team": "for a team", "multiple users": "for multiple users",
    "limited (few users)": "for a few users", "single user": "for a single user", "minimal (single user)": "for a single user",
}

# Notes that say nothing, and what good notes, kinds of fixes, observations and unsafe actions look like.
GENERIC_NOTES = (
    "closed", "fixed", "resolved", "done", "ok", "ok now", "solved", "issue resolved, closing ticket", "user confirmed, closed", "see previous call", "no further action",
    "works again", "restarted", "solved - see call", "closing", "n/a", "na", "-",
)
ACTION = (
    r"\b(restart|recycl|replac|swap|install|increas|extend|configur|set |rolled back|roll back|rollback|deploy|patch|hotfix|reset|clear|rebuil|reimag|import|renew|updat|upgrad|"
    r"moved|archiv|created|added|fixed|correct|unlock|explain|rerun|reran|resync|disabl|enabl|reinstall|power-cycl|gather|kill|terminat|block|enforc|optimi|refresh|expand|"
    r"tun(?:e|ed|ing)\b|capp|lower|rais|rescan|drain|logged|remov|synchroni|align|dispatch|implement|appl(?:y|ied)|reschedul|start(?:ed)?\b|swapp|reimag|repair|re-?enabl|"
    r"reconfigur|escalat)"
)
CAUSE = r"\b(root cause|caused by|due to|because|was (?:full|stale|missing|corrupt|expired|overloaded|exhausted|capped|broken|stuck|hung)|turned out|leak|defect|misconfig|mismatch|expired)"
VERIFY = r"\b(verif|confirm|monitor|test(?:ed)? |back to normal|stable|no (?:more|further) (?:errors|alerts|timeouts)|works again|resolved|since)"
HARDWARE_FIX = r"\b(replac\w*|swapp?ed|supplier|field engineer|hardware|module|sfp|cable|hba|fuser|loan laptop|defect)"
SOFTWARE_FIX = (
    r"\b(patch\w*|hotfix|upgrad\w*|install\w*|roll(?:ed)? ?back|release|configur\w*|restart\w*|recycl\w*|transport|sap note|driver|feature toggle|heap|pool|certificate|policy|job)"
)
USER_FIX = r"\b(explain\w*|instruction|procedure|walk(?:ed)? the user|by design|functional owner|informed the user|change request|enhancement|work instruction|runbook)"
OBSERVE = (
    r"(back to normal|verified|confirmed|no (?:more|further|longer)|stable|dropp\w*|reduc\w*|restored|succe\w+|works? again|normal|operational|below|cleared|reconcil\w*|flat|passed|"
    r"can (?:log in|work|print|send)|available again)"
)
DESTRUCTIVE = (
    r"\b(delet\w*|drop (?:table|database|schema)|truncat\w*|format\w*|wip(?:e|ed|ing)|reimag\w*|rm -rf|restor\w* .{0,30}(?:from|backup)|purg\w*|"
    r"kill\w* .{0,20}(?:session|process)|terminat\w* .{0,20}session|factory reset|reinstall(?:ed)? (?:the )?(?:os|operating system)|archiv\w* or delet\w*)"
)
DISRUPTIVE = r"\b(restart\w*|reboot\w*|recycl\w*|power-cycl\w*|fail(?:ed)? ?over|roll(?:ed)? ?back|rollback|drain\w*|maintenance mode)"

# Restarts that help for a while, with what they imply.
COMBINATION = ("slow response", "freeze / hang")
COMBINATION_PATTERN = r"restart\w* (?:it )?(?:fixes|helps|solves)|after (?:a )?restart it works|works again after (?:a )?restart|fixes it temporarily|comes back"
COMBINATION_CONCEPTS = ("memory leak", "resource exhaustion", "temporary workaround restart")

# Answers to clarifying questions, fields in the order in which they are asked for, and words of work-arounds.
ANSWERS = {
    "single user": "single user", "multiple users": "multiple users", "a whole team": "team", "the whole organization": "organization-wide",
    "yes, after a deployment / release": "deployment / release", "yes, after a configuration change": "configuration change",
    "after patching / maintenance": "patching / maintenance", "no recent change": "no recent change", "production": "Production", "staging": "Staging",
    "development": "Development", "application": "Application", "database": "Database", "network / vpn": "Network", "laptop / workstation": "End-user device", "storage": "Storage",
}
ANSWER_RULES = {"impact_scope": SCOPES, "trigger": TRIGGERS, "environment": ENVIRONMENTS, "component": COMPONENTS}
ASK_WHEN_VAGUE = ("component", "impact_scope", "trigger", "environment")
ASK_TO_SEPARATE = ("component", "trigger", "impact_scope", "environment")
ASK_BEFORE_ESCALATION = ("trigger", "impact_scope", "environment", "component")
WORKAROUNDS = ("restart", "recycl", "reboot", "power-cycl", "clear", "logged it off", "workaround")
