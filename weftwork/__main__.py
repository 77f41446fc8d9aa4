from weftwork.cli import main

raise SystemExit(main())
