"""Texts with secrets of kinds that the training sentences don't have, in settings files and code, and texts of the same look without any."""

import random
import string


def cases(n, seed):
    """(texts with a secret, the secrets, texts without)."""
    r = random.Random(seed)
    mixed = lambda k, more="": "".join(r.choice(string.ascii_letters + string.digits + more) for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    filler = lambda: " ".join(r.choice("the service reads its settings when it starts and writes a log line for each request it could not serve please rotate this before the release".split()) for _ in range(r.randrange(5, 25)))
    kinds = [
        lambda: ("sk_live_" + mixed(24), "STRIPE_SECRET_KEY={}"), lambda: ("AIza" + mixed(35, "-_"), 'maps.init({{ apiKey: "{}" }});'), lambda: ("glpat-" + mixed(20), "git remote add ci https://oauth2:{}@gitlab.example.com/app.git"),
        lambda: ("npm_" + mixed(36), "//registry.example.org/:_authToken={}"), lambda: (mixed(86, "+/") + "==", "DefaultEndpointsProtocol=https;AccountName=logs;AccountKey={};EndpointSuffix=core.example.net"),
        lambda: ("SG." + mixed(22, "-_") + "." + mixed(43, "-_"), "sendgrid:\n  api_key: {}\n  sender: noreply@example.com"), lambda: ("SK" + hexes(32), "twilio = Client(account, '{}')"), lambda: ("github_pat_" + mixed(22) + "_" + mixed(59), "export GH_TOKEN={}"),
        lambda: (mixed(40, "/+"), "[default]\naws_secret_access_key = {}\nregion = eu-west-1"), lambda: (hexes(64), '{{"clientId": "web", "clientSecret": "{}", "scope": "all"}}'), lambda: ("xoxp-" + "-".join(str(r.randrange(10**10, 10**12)) for _ in range(3)) + "-" + hexes(32), "slack_token: '{}'"),
        lambda: ("dop_v1_" + hexes(64), "doctl auth init -t {}"), lambda: ("hf_" + mixed(34), 'login(token="{}")'), lambda: (mixed(16) + str(r.randrange(99)), "db.password={}\ndb.user=app"), lambda: ("eyJhbGciOiJIUzI1NiJ9." + mixed(60) + "." + mixed(43, "-_"), "curl -H 'Authorization: Bearer {}' https://api.example.com/v1/me"),
    ]
    calm = [
        lambda: f"Merge commit {hexes(40)} into main", lambda: f"sha256sum: {hexes(64)}  release.tar.gz", lambda: f"id: {hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", lambda: f"Order {r.randrange(10**9)} shipped on 2024-0{r.randrange(1, 9)}-1{r.randrange(9)}",
        lambda: "See https://www.example.com/docs/getting-started/index.html#install for details", lambda: "The secret of a good key is a steady hand, and the password is patience", lambda: "def token_count(text: str) -> int: return len(text.split())", lambda: f"call +1 (555) 010-{r.randrange(1000, 9999)} or write to help@example.org",
        lambda: "import numpy as np; x = np.zeros((3, 4)); print(x.shape)", lambda: "password: please choose one with at least eight characters", lambda: f"listening on 127.0.0.1:{r.randrange(1000, 9999)}, version 1.{r.randrange(9)}.{r.randrange(9)}",
    ]
    texts, values = [], []
    for _ in range(n):
        value, form = r.choice(kinds)()
        texts.append(filler() + "\n" + form.format(value) + "\n" + filler())
        values.append(value)
    return texts, values, [filler() + "\n" + r.choice(calm)() + "\n" + filler() for _ in range(n)]
