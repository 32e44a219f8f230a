"""Seeded texts in SQL that Spark and DuckDB both run: one for each rule, over columns k and h (a hash in hex)."""

KEYED = "(select o_orderkey as k, md5(cast(o_orderkey as string)) as h from orders)"
AWS = "'AKIA' || upper(translate(substr(h,1,16),'0189','ghjk'))"
DIGITS = "translate(h,'abcdef','123456')"
BASE58 = "translate(h,'0','z')"

#: Mixed tool output.
MIXED = f"""case k % 4 when 0 then 'clean line ' || h
  when 1 then 'id=' || {AWS} || ' tail'
  when 2 then 'a ' || 'ghp_' || h || '0123 and ' || {AWS}
  else 'Authorization: ' || 'Bearer ' || h end"""

SEEDS = {
    "aws-access-key": f"'id=' || {AWS} || ' tail'",
    "github-pat-classic": "'t ' || 'ghp_' || h || '0123'",
    "github-pat-finegrained": "'t ' || 'github_pat_' || '11' || h || h || substr(h,1,16)",
    "github-app-token": "'t ' || 'ghs_' || h || '0123'",
    "gitlab-pat": "'t ' || 'glpat-' || substr(h,1,20)",
    "slack-token": "'t ' || 'xoxb-' || '1234567890-' || substr(h,1,20)",
    "stripe-secret-key": "'t ' || 'sk_live_' || substr(h,1,24)",
    "aws-session-token": "'t ' || 'IQoJ' || h || h || h || h",
    "aws-secret-access-key": "'aws_secret_' || 'access_key = ' || h || substr(h,1,8)",
    "db-connection-uri": "'postgres' || '://u:' || substr(h,1,12) || '@db.example/x'",
    "url-userinfo-credential": "'https' || '://u:' || case when k % 5 = 0 then 'password' else substr(h,1,12) end || '@host.example/x'",
    "sendgrid-api-key": "'t ' || 'SG.' || substr(h,1,22) || '.' || h || substr(h,1,11)",
    "http-basic-auth": "'Authorization: ' || 'Basic ' || substr(h,1,24)",
    "bearer-token": "'Authorization: ' || 'Bearer ' || h",
    "sourcegraph-access-token": "'t ' || 'sgp_' || h || substr(h,1,8) || ' end'",
    "redis-auth-command": "'AUTH ' || case when k % 5 = 0 then '$REDIS_PASSWORD_LONG1' else 'Z' || h end",
    "redis-auth-array": "'[\"AUTH\",\"svc\",\"' || case when k % 5 = 0 then 'process.env.PW' else h end || '\"]'",
    "redis-auth-resp": "'*2 $4 auth $32 ' || h || ' done'",
    "redis-auth-cli": "'redis-cli -h x -a ' || h || ' ping'",
    "pii-btc-p2pkh": f"'pay 1' || {BASE58} || case when k % 5 = 0 then ' genesis block' else ' now' end",
    "pii-btc-bech32": "'pay bc1' || h || ' now'",
    "pii-eth-address": "'pay 0x' || h || substr(h,1,8) || ' now'",
    "pii-eth-raw-privkey": "'privkey ' || h || h || ' end'",
    "pii-crypto-xpub": f"'x xpub' || {BASE58} || {BASE58} || {BASE58} || substr({BASE58},1,8) || ' end'",
    "pii-crypto-wif-privkey": f"'x K' || {BASE58} || substr({BASE58},1,19) || ' end'",
    "pii-crypto-seed-phrase": "repeat('zebra ',11) || case when k % 5 = 0 then 'that' else 'ozone' end",
    "pii-credit-card": f"'card ' || substr({DIGITS},1,16) || ' end'",
    "pii-iban": f"'iban DE44' || substr({DIGITS},1,18) || ' end'",
    "pii-ssn": "'ssn 123-45-' || lpad(cast(k % 10000 as string),4,'0')",
    "pii-bank-routing": f"'routing ' || substr({DIGITS},1,9) || ' end'",
    "pii-bank-account": f"'account ' || substr({DIGITS},1,12) || ' end'",
}
