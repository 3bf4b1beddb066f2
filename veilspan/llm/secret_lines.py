"""Drafted lines of code, configuration, logs and commands with the credentials in them marked.

They are the training rows of the field in ``secrets``: forms are drawn from the lists below and filled from a seeded
generator, so that every run trains on the same rows.
"""

from __future__ import annotations

import base64
import random
import re
import string
from collections.abc import Iterator

LINES = 6000
_WORDS = "amber anchor barley basket candle canyon cedar copper delta ember falcon forest garden harbor island jasmine kettle lantern maple meadow nectar orchard pebble quartz river saddle timber umbra valley willow yonder zephyr atelier brume colline dune etang fanal grange havre ilot jardin levant moulin nuage ombre phare quai rive sentier toit urne voile".split()
_ALNUM = string.ascii_letters + string.digits
_NAMES = "password passwd pwd pass db_password DB_PASSWORD redis_password admin_pwd smtp_pass mot_de_passe MOT_DE_PASSE mdp mdp_base api_key API_KEY apiKey access_token ACCESS_TOKEN client_secret CLIENT_SECRET clientSecret token auth_token secret JWT_SECRET jwt_secret signing_key SIGNING_SECRET private_key encryption_key dbPassword adminPwd smtpPass ldap_bind_password aws_secret_access_key AWS_SECRET_ACCESS_KEY aws_access_key_id AWS_ACCESS_KEY_ID awsAccessKeyId github_token GITHUB_TOKEN stripe_secret_key STRIPE_SECRET_KEY openai_api_key npm_token NPM_TOKEN slack_bot_token maps_key MAPS_KEY npmToken stripeSecretKey session_token sessionToken SESSION_TOKEN acme_apikey acme-client-secret ldap-bind-password webhook_secret SECRET_KEY_BASE aws-access-key-id openai-api-key".split()
_META = "password_file token_ttl PASSWORD_MIN_LENGTH maxTokens max_tokens tokens_total tokens_used TOKENIZER_WIDTH tokenizer_name secretRef secret_name passwordField password_hash key_id api_key_file token_count SESSION_ID_NAME api_key_name token_type keyboard_layout password_policy author".split()
_PUBLIC = "PUBLISHABLE_KEY publishable_key public_key publishableKey PUBLIC_KEY STRIPE_PUBLISHABLE_KEY".split()
_CHOSEN = "password passwd pwd pass passphrase PASSPHRASE db_password DB_PASSWORD redis_password admin_pwd smtp_pass mot_de_passe MOT_DE_PASSE mdp mdp_base dbPassword adminPwd smtpPass ldap_bind_password ldap-bind-password userPassword PGPASSWORD secret".split()
_STAND_INS = "changeme required optional none null None true false example string str default todo unset obligatoire password secret".split()
_MARKS = "commit sha256 digest etag checksum GIT_COMMIT build_id trace request_id revision integrity COMMIT version fingerprint md5".split()
_HOSTS = "db.acme.example cache.north.test api.hill.invalid queue.lake.example pg-2.acme.test localhost 10.0.0.7".split()
_SCHEMES = "postgres postgresql mysql redis amqp amqps mongodb mongodb+srv https ftp".split()

# Forms: {S} a secret, {N} a name of one, {M} a name about one, {P} a public name, {F} a fingerprint's name, {f} a
# fingerprint, {r} a reference or mask, {w} a word, {W} two words, {n} a number, {h} a host, {p} a path, {c} a scheme.
_CASES = """
{N}={S}
{N}='{S}'
{N}="{S}"
export {N}={S}
export {N}="{S}"
export {N}='{S}'
{N} = '{S}'
{N} = "{S}"
{N} = str('{S}')
    {N} = "{S}"
  {N}: {S}
  {N}: "{S}"
  {N}: '{S}'
  {N}: {E}  # base64
  "{N}": "{S}",
  <{N}>{S}</{N}>
  <entry key="{N}" value="{S}"/>
  <property name="{N}" value="{S}" />
  <entry key="{D}" value="{S}"/>
  <property name="{D}" value="{S}" />
{D}={S}
{D} = {S}
Server={h};Uid=svc;Pwd={S};Timeout=30
Server={h};Database={w};User Id={w};Password={S};
jdbc:sqlserver://{h};user={w};password={S}
{T} DEBUG login user=svc password={S} ok
{T} INFO login user={w} passwd={S} ok
{T} DEBUG Authorization: Bearer {L}
{T} DEBUG Authorization: Basic {E}
{T} DEBUG connect {c}://{w}:{S}@{h}:{n} failed, retry
{T} DEBUG GET https://{h}/v1/{w}?access_token={L}&page={n} 200
{T} DEBUG GET https://{h}/v1/{w}?sig_token={L}&page={n} 200
{T} INFO GET https://{h}/{w}?api_key={L} 200
{T} DEBUG body={"user":"svc","password":"{S}"}
{p}:{n}:{T} DEBUG Authorization: Bearer {L}
curl -H "Authorization: Bearer {L}" https://{h}/v2
curl -H 'Authorization: Basic {E}' https://{h}
curl -H "X-Api-Key: {L}" https://{h}
curl -s -u {w}:{S} https://{h}/status
curl -u "{w}:{S}" https://{h}
deploy --user ops --password {S} --dry-run
mysql -h {h} -u {w} --password={S}
tool --token {L} push
PGPASSWORD={S} psql -h {h} -U {w}
//registry.{h}/:_authToken={L}
machine {h} login svc password {S}
CREATE USER {w} IDENTIFIED BY '{S}';
CREATE USER {w} IDENTIFIED BY '{S}';
ALTER USER {w} IDENTIFIED BY '{S}';
ALTER ROLE {w} WITH PASSWORD '{S}';
DATABASE_URL={c}://{w}:{S}@{h}:{n}/{w}
BROKER={c}://:{S}@{h}:{n}/{w}
{w}_URI={c}://{w}:{S}@{h}/{w}
  url: {c}://{w}:{S}@{h}/{w}
  dsn: "{c}://{w}:{S}@{h}:{n}/{w}"
    engine = create("{c}://{w}:{S}@{h}/{w}")
    conn = connect("{h}", user="svc", password="{S}")
    conn = connect(host="{h}", password='{S}', port={n})
    headers = {"Authorization": "{L}"}
    headers = {"X-Api-Key": "{L}"}
    headers = {"X-Auth-Token": "{L}"}
    client = Client(api_key="{L}", timeout={n})
# mdp de recette : {S}
    # ancien mot de passe : {S}
    # temp password : {S}
the password is {S}
The {w} {W}. the password is {S} and more.
Le mot de passe est {S}
Nouveau mdp : {S}
Identifiant svc, mot de passe : {S}
my token {L}
here is the token: {L}
Voici la clé d'API : {L}
git clone https://{w}:{L}@{h}/{w}.git
{p}:{n}:{N}={S}
{p}:{n}:  {N}: "{S}"
{p}:{n}:    {N} = "{S}"
""".strip("\n").split("\n")  # fmt: skip
# Values that people choose, under names that ask for one: words, numbers, short ones, phrases in quotes.
_WEAK = """
{C}={V}
{C}='{V}'
{C}="{V}"
{C}: {V}
{C}: "{V}"
{C} = "{V}"
{C}="{V}"
{C}='{V}'
export {C}={V}
export {C}="{V}"
  {C}: {V}
  {C}: '{V}'
  "{C}": "{V}",
    {C} = '{V}'
{p}:{n}:{C}={V}
{T} DEBUG login user=svc password={V} ok
Server={h};Uid=svc;Pwd={V};Timeout=30
passphrase: "{Q}"
passphrase="{Q}"
{C}: '{Q}'
  {C}: "{Q}"
{C}="{Q}"
{D}={V}
  <entry key="{D}" value="{V}"/>
{w}_WEBHOOK=https://{h}/services/{X}/{X}/{L}
{w}_webhook: https://{h}/hooks/{L}
""".strip("\n").split("\n")  # fmt: skip
_NONE = """
{C}={I}
  {C}: {I}
  "{C}": "{I}",
{C}: {I}
{C} = {I}
  {C}: {C}
{C}={C}
    {C} = {C}
    {w}({C}={C}, {w}={w})
pwd: {p}
PWD={p}
cd {p} && pwd
password {w} {w} {w}
{C} {w} {w}
INSERT INTO {A} VALUES ({n}, '{w}', NULL);
INSERT INTO {w} VALUES ({n}, '{w}', '{w}', NULL);
UPDATE {A} SET {w} = '{w}' WHERE id = {n};
UPDATE {A} SET {F} = '{f}';
UPDATE {A} SET {F} = '{f}' WHERE id = {n};
SELECT {w} FROM {A} WHERE {w} = '{w}';
{w} {w} {A} de l'{w} {w} l'{w} de la {w}. {W} l'{w} {w}.
L'{A} de l'{w} {w} d'{w}, {w} l'{w}.
see https://{h}/services/{X}/{X}/{w}
{w}_URL=https://{h}/services/{X}/{w}
  url: https://{h}/{w}/{w}/{n}
  {C}: [
  {C}:
{P}={K}
  {P}: {K}
  "{P}": "{K}",
    {P} = "{K}"
GIT_COMMIT={f}
    COMMIT = "{f}"
  {F}: {f}
{F}={f}
  "{F}": "{f}",
  <{F}>{f}</{F}>
  digest: sha256:{f}
{p}:{n}:  digest: sha256:{f}
{p}:{n}:  {F}: {f}
  "integrity": "sha512-{e}==",
{T} INFO commit {f}
{T} INFO request_id={f}
{T} INFO prompt tokens={n} completion tokens={n}
{T} ERROR bad password for user svc
{T} WARN {N}={r}
{T} INFO {w} done in {n} ms
git checkout {f}
commit {f}
sha256sum {w}.tar  # {f}
{f}  {w}.tar
{N}=
{N}={r}
{N}="{r}"
  {N}: {r}
  {N}: '{r}'
  {N}: "{r}"
  {N}: {r}
  "{M}": "env:{N}",
  "secretRef": "env:{N}",
  {N}_file: /run/secrets/{w}
  {M}: {n}
{M}={n}
  "{M}": {n},
  "{M}": "{w}",
    {N} = os.environ["{N}"]
    {N} = settings.get("{N}")
    {N} = getpass.getpass()
    {N} = load({w}, limit={n})
    token = tokens[{n}]
    tokens_used=tokens_used,
    assert check_password({w}, stored)
    def reset_password(self, {w}): ...
  <{N} ref="{w}"/>
  <{N}>{r}</{N}>
-- {N} managed by the vault
read -s {N}
SELECT password_hash IS NULL FROM {w};
Server={h};Integrated Security=true
curl -H "Authorization: Bearer ${N}" https://{h}
curl https://{h}/{w}?page={n}
ssh-keygen -y -f keys/{w}.pub
ssh-ed25519 {e} {w}@{h}
git clone git@{h}:{w}/{w}.git
git clone https://{h}/{w}/{w}.git
Author: {w} <{w}.{w}@{h}>
Contact : {w} {w} <{w}.{w}+{w}@{h}>, poste {n}
{w} {W}. Nom : {w} ; courriel : {U}@{h} ; {W}
{n} | {w} {w} | {U}@{h} | {n} | {w}
{n},{w} {w},{w}{n}@{h},{n},{w}
contact: {w}_{w}+{w}@{h}
{w} {w} passport {n}AB{n}, {W}. Identifiant {w}{n}.
UPDATE {w} SET etag = '{f}';
{w} {w} token {W} {W}.
The key of the {w} {W} and the password of the {W}.
Le mot de passe du {w} {W}.
mot de passe oublié ? voir https://{h}/reset
{N}=changeme
  {N}: <your-{w}-value>
see https://{h}/{w}/{w}-{n}
{n};{w};{w}.{w}{n}@{h};;{w}
key: {w}
  key: {w}_{w}
{w}_KEY_PATH={p}
    access_token = {w}.access_token
    password = request.form["password"]
    api_key = config.api_key
{p}:{n}:    {N} = os.environ["{N}"]
""".strip("\n").split("\n")  # fmt: skip
_FIELD = re.compile(r"\{([A-Za-z])\}")


class _Draft:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def chars(self, n: int, among: str = _ALNUM) -> str:
        return "".join(self.r.choice(among) for _ in range(n))

    def secret(self) -> str:
        r = self.r
        w, v = r.choice(_WORDS), r.choice(_WORDS)
        kind = r.randrange(13)
        if kind < 3:
            return f"{w.title()}-{v.title()}{r.randrange(100, 9999)}"
        if kind < 5:
            return f"{w}{r.choice('-._')}{self.chars(4, string.ascii_lowercase)}{r.choice('!*+%#')}{r.randrange(10, 9999)}"
        if kind < 7:
            return f"{self.chars(r.randrange(8, 16))}{r.choice('!*+%#')}{r.randrange(10, 99)}"
        if kind < 9:
            return self.chars(r.randrange(12, 28))
        if kind == 12:
            return self.chars(r.randrange(12, 20), string.ascii_letters)
        return base64.b64encode(r.randbytes(32)).decode() if kind == 9 else self.long()

    def long(self) -> str:
        r = self.r
        kind = r.randrange(14)
        ranges = ("sk_live_" + self.chars(24), "sk-proj-" + self.chars(40, _ALNUM + "_-"), "ghp_" + self.chars(36), "npm_" + self.chars(36), f"xoxb-{r.randrange(10**11)}-{r.randrange(10**12)}-{self.chars(24)}", "AKIA" + self.chars(16, string.ascii_uppercase + "234567"), "AIza" + self.chars(29), "eyJ" + self.chars(33) + "." + self.chars(44) + "." + self.chars(43, _ALNUM + "_-"), self.chars(32, "0123456789abcdef"), self.chars(64, "0123456789abcdef"), self.chars(40), self.chars(32), self.chars(40, _ALNUM + "/+"), "sk-ant-" + self.chars(32))
        return ranges[kind]

    def weak(self) -> str:
        r = self.r
        w, v = r.choice(_WORDS), r.choice(_WORDS)
        forms = (w, w + v, w + v + r.choice(_WORDS), w.title(), f"{w}{r.randrange(10)}", f"{w}{r.randrange(10, 9999)}", str(r.randrange(1000, 10**9)), self.chars(2, string.ascii_lowercase) + str(r.randrange(10, 99)), self.chars(3) + r.choice("!*+%#") + self.chars(1), self.chars(r.randrange(5, 8), string.ascii_lowercase), self.chars(4, string.ascii_lowercase) + str(r.randrange(10)) + r.choice("!*+%#"))
        return r.choice(forms)

    def encoded(self) -> str:
        return base64.b64encode(f"{self.r.choice(_WORDS)}:{self.secret()}".encode()).decode()

    def mark(self) -> str:
        r = self.r
        return (lambda: self.chars(40, "0123456789abcdef"), lambda: self.chars(64, "0123456789abcdef"), lambda: self.chars(32, "0123456789abcdef"), lambda: self.chars(10, "0123456789abcdef"), lambda: "-".join(self.chars(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12)))[r.randrange(5)]()

    def reference(self) -> str:
        r = self.r
        n = r.choice(_NAMES)
        return r.choice([f"${{{n}}}", f"${{{{ secrets.{n.upper()} }}}}", "********", "[REDACTED]", "⟦SECRET_ASSIGNMENT:REDACTED⟧", f"<your-{r.choice(_WORDS)}-value>", f"%({r.choice(_WORDS)})s", f"${n}", f"{{{{ {n} }}}}", "xxxxxxxx", f"vault:{r.choice(_WORDS)}/prod#{n}"])

    def field(self, name: str) -> str:
        r = self.r
        words = lambda: r.choice(_WORDS)
        make = {
            "V": self.weak, "Q": lambda: " ".join(r.choice(_WORDS) for _ in range(r.randrange(2, 6))), "C": lambda: r.choice(_CHOSEN), "D": lambda: re.sub("[-_]", ".", r.choice([c for c in _CHOSEN if re.search("[-_]", c)])).lower(), "I": lambda: r.choice(_STAND_INS), "A": lambda: r.choice(["token", "jeton", "secret", "clef", "clé", "password", "cookie", "key", "credential", "pass"]), "X": lambda: r.choice("TB") + self.chars(8, string.ascii_uppercase + string.digits),
            "S": self.secret, "L": self.long, "E": self.encoded, "N": lambda: r.choice(_NAMES), "M": lambda: r.choice(_META), "P": lambda: r.choice(_PUBLIC), "F": lambda: r.choice(_MARKS),
            "f": self.mark, "e": lambda: base64.b64encode(r.randbytes(60)).decode().rstrip("="), "K": lambda: "pk_live_" + self.chars(24), "r": self.reference, "U": lambda: r.choice([f"{words()}.{words()}+{words()}", f"{words()}_{words()}{r.randrange(99)}", f"{words()}.{words()}+{words()}".upper(), f"{words()}-{words()}".upper()]), "w": words, "W": lambda: f"{words()} {words()} {words()}",
            "n": lambda: str(r.randrange(1, 9000)), "h": lambda: r.choice(_HOSTS), "p": lambda: f"{r.choice(['src', 'conf', 'docs', '/work/data'])}/{words()}_{words()}.{r.choice(['py', 'env', 'md', 'yml'])}", "c": lambda: r.choice(_SCHEMES),
            "T": lambda: f"2026-0{r.randrange(1, 9)}-{r.randrange(10, 28)} {r.randrange(10, 23)}:{r.randrange(10, 59)}:{r.randrange(10, 59)}",
        }
        return make[name]()


def drafted(lines: int, seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """``lines`` lines, each with the half-open spans of its credentials."""
    draft = _Draft(seed)
    for i in range(lines):
        if i % 60 == 0:
            kind = draft.r.choice(["RSA PRIVATE", "PRIVATE", "OPENSSH PRIVATE", "EC PRIVATE", "PUBLIC", "ENCRYPTED PRIVATE"])
            text = f"-----BEGIN {kind} KEY-----\n{draft.chars(64)}\n{draft.chars(64)}\n-----END {kind} KEY-----"
            yield text, [(0, len(text))] if "PRIVATE" in kind else []
            continue
        share = draft.r.random()
        form = draft.r.choice(_CASES if share < 0.4 else _WEAK if share < 0.55 else _NONE)
        out, spans, at = "", [], 0
        for m in _FIELD.finditer(form):
            out += form[at : m.start()]
            text = draft.field(m.group(1))
            if m.group(1) in "SLEVQ":
                spans.append((len(out), len(out) + len(text)))
            out += text
            at = m.end()
        yield out + form[at:], spans
