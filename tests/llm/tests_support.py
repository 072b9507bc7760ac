def unrelated_text(k: int, n: int = 120) -> str:
    return " ".join(f"text{k}word{i * 7919 % 1009}" for i in range(n))
