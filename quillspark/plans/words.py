"""What several SQL texts share: folding, and the words that they look for, spelled here and not taken from the operators."""

from __future__ import annotations


def q(s: str) -> str:
    return s.replace("'", "''")


def fold(c: str) -> str:
    return rf"regexp_replace(strip_accents({c}), '\p{{M}}+', '', 'g')"


# Categories of skills by words in their folded form, in the order in which they're tried.
CATEGORY_WORDS = {
    "Architecture & Conception": "architecture|urbanisation|referentiel|soa|eda|eip|paas|iaas|caas|stream-processing|asynchrone|conception",
    "Cloud & DevOps": "aws|azure|gcp|docker|kubernetes|openshift|jenkins|gitlab|nexus|devops|ci/cd|cicd|terraform|svn|github|bitbucket|webpack|gulp|bower|lambda|apigateway|api gateway|cloudfront",
    "Observabilité": "dynatrace|elastic|logstash|kibana|grafana|graphana|beats|apm|sla|slo",
    "Sécurité": "jwt|oauth|jaas|loginmodule|ldap|x509|openssl|pkcs|owasp|authentification|signature|non-repudiation|non repudiation",
    "Bases de données": "sql|mysql|postgres|oracle|mongodb|sybase|db2|mariadb|hibernate|dynamodb|redis",
    "Langages & Frameworks": "java|spring|php|c#|node|typescript|jni|jdbc|groovy|angular|html5|websocket|react|vue|next|symfony|drupal|ezpublish|zend|doctrine|sass|less|bootstrap|jquery|redux|requirejs|javascript|es6|css3",
    "Méthodologies": "togaf|c4|ddd|safe|scrum|agile|roadmap|audit|directeur|direction d'equipe|jira|confluence|redmine|mantis|code review",
    "Systèmes & Environnements": "linux|rhel|aix|centos|ubuntu|windows|apache|nginx|phpstorm|sublime|postman|assembla|akamai|algolia|auth0|cognito",
}


def category_case(folded: str) -> str:
    """The first category of which a folded text holds a word, else null."""
    return "CASE " + " ".join(f"WHEN regexp_matches({folded}, '{q(words)}') THEN '{q(name)}'" for name, words in CATEGORY_WORDS.items()) + " END"


# Words that no name has.
REJECTED_WORDS = (
    "production gestion flux donnees donnee fichiers fichier competences experiences experience professionnelles professionnelle formation formations missions mission profil resume objectif projet projets sql server edi transact ssis api "
    "sftp postgre postgresql data analyst engineer responsable applicatif applicative developpeur developpeuse architecte senior niveau langue langues universite ingenieur java spring devops docker kubernetes aws azure python javascript "
    "typescript react angular vue node php ruby golang rust terraform ansible jenkins gitlab jira confluence agile scrum kanban sre linux windows macos ios android reactjs nextjs vuejs nuxt nestjs dotnet csharp cpp postgres mysql mongodb "
    "redis kafka spark hadoop snowflake airflow dbt etl elt sap oracle salesforce figma sketch master licence bachelor doctorat docteur phd bts dut baccalaureat baccalaureate bac these memoire diplome certification certificat hnd hnc mba "
    "cap bep dea dess deps ingenierie programmation langages infrastructure conteneurisation orchestration securite observabilite proactivite initiatives atouts frameworks outils collaboration esprit reseau reseaux centres interet homelab "
    "retrogaming guitare competence analyse"
)
